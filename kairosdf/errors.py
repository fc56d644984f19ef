"""Errors that stop a run."""


class DataConflictError(ValueError):
    """Rows share a key but differ in content, or refer to what doesn't exist."""
