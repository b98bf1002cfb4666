"""Versioned tables, their log and locks."""
