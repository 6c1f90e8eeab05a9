"""What can be wrong with a statement, or with a row that it is applied to."""

from __future__ import annotations


class SqlError(ValueError):
    """An error with the byte range of the statement that it is about."""

    kind = "SqlError"

    def __init__(self, message: str, span: tuple[int, int] | None = None):
        super().__init__(f"{self.kind}: {message}" + (f" at {span[0]}..{span[1]}" if span else ""))
        self.span = span


class LexError(SqlError):
    kind = "LexError"


class UnexpectedToken(SqlError):
    kind = "UnexpectedToken"


class ExpectedToken(SqlError):
    kind = "ExpectedToken"


class InvalidNumber(SqlError):
    kind = "InvalidNumber"


class UnsupportedFeature(SqlError):
    kind = "UnsupportedFeature"


class UnknownColumn(SqlError):
    kind = "UnknownColumn"


class UnsupportedFunction(SqlError):
    kind = "UnsupportedFunction"


#: Kinds of error of a row; the row is dropped and counted.
TYPE_MISMATCH, DIVIDE_BY_ZERO, OVERFLOW = "TypeMismatch", "DivideByZero", "ArithmeticOverflow"
