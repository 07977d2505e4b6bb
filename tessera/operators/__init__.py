"""Relational operators: records, columns, reductions, nesting, containers."""
