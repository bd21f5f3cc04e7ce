"""Operators for training-data pipelines: filtering, deduplication, masking, extraction, mixing."""
