"""Outcome codes and the exceptions that carry them."""

from __future__ import annotations

import re
from enum import IntEnum


class Status(IntEnum):
    """Stable codes that callers may compare or print by name."""

    OK = 0
    UNIMPLEMENTED = 1
    NOT_FOUND = 2
    DUPLICATE_KEY = 3
    FULL = 4
    IO_ERROR = 5
    INVALID_ARGUMENT = 6
    TYPE_MISMATCH = 7
    DEADLOCK = 8
    ABORTED = 9
    TXN_CONFLICT = 10
    DONE = 11


class EngineError(Exception):
    """An error with the status that execute_update() reports."""

    status = Status.INVALID_ARGUMENT

    def __init__(self, message: str, status: Status | None = None) -> None:
        super().__init__(message)
        if status is not None:
            self.status = status


def as_engine_error(error: Exception) -> EngineError:
    """An error of Spark's as one of ours: what a value did wrong is an argument's fault, all else is an IO error."""
    from pyspark.errors import AnalysisException, ArithmeticException, NumberFormatException

    if isinstance(error, EngineError):
        return error
    text = str(error)
    wrong = isinstance(error, (AnalysisException, ArithmeticException, NumberFormatException)) or re.search("OVERFLOW|DIVIDE_BY_ZERO|ArithmeticException|CAST_INVALID_INPUT|OUT_OF_RANGE", text)
    return EngineError(text.splitlines()[0] if text else type(error).__name__, Status.INVALID_ARGUMENT if wrong else Status.IO_ERROR)


class ParseError(EngineError):
    """Text that is not in the dialect; says where it stops being."""


class NotFound(EngineError):
    status = Status.NOT_FOUND


class TypeMismatch(EngineError):
    status = Status.TYPE_MISMATCH


class DuplicateKey(EngineError):
    status = Status.DUPLICATE_KEY


class Deadlock(EngineError):
    status = Status.DEADLOCK


class TxnConflict(EngineError):
    status = Status.TXN_CONFLICT
