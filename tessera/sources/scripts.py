"""Statements from a file, split by the lexer, so that a semicolon or dashes in a string end nothing."""

from __future__ import annotations

from tessera.dialect import tree
from tessera.dialect.parser import parse_script


def read_script(path: str) -> list[tree.Statement]:
    with open(path, encoding="utf-8") as f:
        return parse_script(f.read())


def complete(text: str) -> bool:
    """Does typed text end a statement? Its last token is a semicolon."""
    from tessera.dialect.lexer import tokenize
    from tessera.errors import ParseError

    try:
        tokens = tokenize(text)
    except ParseError:
        return False
    return len(tokens) > 1 and tokens[-2].value == ";" and tokens[-2].kind == "symbol"
