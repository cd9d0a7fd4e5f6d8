"""Operators over DataFrames; batch and streaming call the same functions where Spark allows."""
