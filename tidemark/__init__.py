"""Spark-first analytics for ordered financial and signal data."""
