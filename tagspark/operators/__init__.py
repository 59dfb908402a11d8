"""Relational operators: DataFrames in, DataFrames out, no actions unless stated."""
