"""Posting and document analytics as DataFrame-in, DataFrame-out Spark operators."""
