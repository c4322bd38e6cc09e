"""Relational operators: DataFrames in, lazy DataFrames out."""
