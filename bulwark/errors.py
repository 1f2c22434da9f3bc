"""Errors of the engine."""

from __future__ import annotations


class BulwarkError(Exception):
    """Base of all; ``code`` and ``details`` describe it."""

    code = "BULWARK_ERROR"

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.details = details


class ValidationFailed(BulwarkError):
    code = "VALIDATION_FAILED"


class ExecutionFailed(BulwarkError):
    code = "EXECUTION_FAILED"


class TimedOut(BulwarkError):
    code = "TIMED_OUT"


class ConfigurationError(BulwarkError):
    code = "CONFIGURATION_ERROR"


class InputBlocked(BulwarkError):
    code = "INPUT_BLOCKED"


class OutputBlocked(BulwarkError):
    code = "OUTPUT_BLOCKED"


class MiddlewareError(BulwarkError):
    code = "MIDDLEWARE_ERROR"


class ParameterRejected(BulwarkError):
    code = "PARAMETER_REJECTED"


class ScopeDenied(BulwarkError):
    code = "SCOPE_DENIED"


class StreamAborted(BulwarkError):
    code = "STREAM_ABORTED"


def error_info(error: BaseException) -> dict:
    """Name, code, message and details of any error."""
    own = isinstance(error, BulwarkError)
    return {"name": type(error).__name__, "code": error.code if own else "UNKNOWN", "message": str(error), "details": error.details if own else {}}
