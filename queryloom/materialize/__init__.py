"""Materialized tables: manifests, generations, refresh planning, the refresh job, administration."""
