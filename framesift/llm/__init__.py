"""Operators for training-data pipelines: cleaning, deduplication, mixing and token output."""
