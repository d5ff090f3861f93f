"""Operators on DataFrames of documents, chunks and evidence."""
