"""Statements that write."""
