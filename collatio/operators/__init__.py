"""Relational operators: alignment, matrix, statistics."""
