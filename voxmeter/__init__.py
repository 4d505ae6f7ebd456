"""Spark-native analytics for recognition-and-rejection pipelines."""
