"""Operators for training-data pipelines over whole text and vector tables."""
