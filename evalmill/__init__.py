"""Evaluation analytics on Spark: plans, replies, reconciliation, metrics and data-quality operators."""
