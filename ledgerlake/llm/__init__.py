"""Operators on texts and record groups for training-data pipelines."""
