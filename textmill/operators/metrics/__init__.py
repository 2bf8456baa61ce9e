"""Evaluation metrics: per-row statistics followed by one aggregation."""
