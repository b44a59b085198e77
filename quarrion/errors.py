"""What the engine raises before a query runs."""


class QueryError(ValueError):
    """A statement or call that can be rejected without touching data."""


class LexError(QueryError):
    def __init__(self, offset: int, message: str):
        super().__init__(f"sql: lexer error at offset {offset}: {message}")
        self.offset = offset


class ParseError(QueryError):
    def __init__(self, offset: int, message: str):
        super().__init__(f"sql: parse error at offset {offset}: {message}")
        self.offset = offset


class PlanError(QueryError):
    def __init__(self, message: str):
        super().__init__(f"sql: planner: {message}")


class FormatError(ValueError):
    """A file or byte stream that does not follow its format."""
