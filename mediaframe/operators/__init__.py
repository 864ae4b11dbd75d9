"""Relational operators over media tables; DataFrames in, DataFrames out."""
