"""Errors raised on the driver before a job starts."""


class InvalidArgument(ValueError):
    """An argument is outside of what an operator accepts."""


class NotFound(LookupError):
    """A row that an operation names does not exist."""


class FailedPrecondition(RuntimeError):
    """An operation needs a state that is not there, such as a built index."""
