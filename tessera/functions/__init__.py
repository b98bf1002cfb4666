"""Expressions of the dialect as Columns."""
