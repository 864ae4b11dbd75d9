"""Operators for training-data pipelines: text, web pages, benchmark and label tables."""
