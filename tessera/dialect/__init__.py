"""Lexer, tree, parser and printer."""
