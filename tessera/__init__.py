"""Batch code-and-document retrieval on Spark: chunks, vectors, property graph, reports."""
