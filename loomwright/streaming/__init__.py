"""Structured Streaming entry points for row-wise operators."""
