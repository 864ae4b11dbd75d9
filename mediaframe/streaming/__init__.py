"""Structured Streaming versions of the windowed and stateful operators."""
