"""Exceptions of the query layer."""


class ValidationError(ValueError):
    """A query document that breaks the rules of its statement type."""


class CompileError(ValueError):
    """A valid document that cannot be turned into a plan."""


class ExecutionError(RuntimeError):
    """A plan that failed while it ran (duplicate key, null in a required column, ...)."""
