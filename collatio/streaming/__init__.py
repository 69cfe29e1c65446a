"""Incremental maintenance of the matrix with Structured Streaming."""
