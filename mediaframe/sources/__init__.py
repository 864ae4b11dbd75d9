"""Readers and writers for the documents and files the operators start from or end in."""
