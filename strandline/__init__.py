"""Spark-native analytics of social event streams."""
