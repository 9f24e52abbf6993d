"""What the engine raises."""


class EngineError(Exception):
    """The base of the engine's errors."""


class SyntaxFault(EngineError):
    """A statement that the dialect doesn't have."""


class NotFound(EngineError):
    """A table, view, column or row that isn't there."""


class Duplicate(EngineError):
    """A table that is already there."""


class TypeMismatch(EngineError):
    """A value that doesn't fit a column."""


class ConstraintViolation(EngineError):
    """Rows that a constraint refuses; ``kind`` names it."""

    def __init__(self, kind: str, detail: str):
        super().__init__(f"{kind}: {detail}")
        self.kind = kind


class TransactionFault(EngineError):
    """A transaction or savepoint that isn't open, or is already."""


class ReadOnly(EngineError):
    """A change in a session that only reads."""


def wrapped(error: Exception) -> EngineError:
    """The engine's error for one of Spark's."""
    condition = (getattr(error, "getCondition", lambda: None)() or "") if not isinstance(error, EngineError) else ""
    text = str(error).split("\n", 1)[0]
    if isinstance(error, EngineError):
        return error
    if condition.startswith(("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN", "UNRESOLVED_ROUTINE", "UNRESOLVED_FIELD")):
        return NotFound(text)
    if condition.startswith(("DATATYPE_MISMATCH", "CAST_", "INVALID_FORMAT", "WRONG_NUM_ARGS", "INCOMPATIBLE")):
        return TypeMismatch(text)
    if condition.startswith(("PARSE", "INVALID_SQL")) or type(error).__name__ == "ParseException":
        return SyntaxFault(text)
    return EngineError(text)
