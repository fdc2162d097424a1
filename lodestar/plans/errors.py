"""Errors that point at their place in the text."""

from __future__ import annotations


class EngineError(Exception):
    """Any error of the engine itself."""


class SourceError(EngineError):
    """An error at a place of the statement, shown with its line and a mark."""

    stage = "error"

    def __init__(self, message: str, text: str = "", at: int = 0) -> None:
        self.message = message
        self.line = text.count("\n", 0, at) + 1
        start = text.rfind("\n", 0, at) + 1
        self.column = at - start + 1
        shown = text[start:].split("\n", 1)[0]
        super().__init__(f"{self.stage} at line {self.line}, col {self.column}: {message}\n  {shown}\n  {' ' * (self.column - 1)}^")


class ParseError(SourceError):
    stage = "parse error"


class BindError(SourceError):
    stage = "bind error"


class ConstraintError(EngineError):
    """A row that breaks NOT NULL, a length, PRIMARY KEY or UNIQUE."""
