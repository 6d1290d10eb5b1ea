"""Spark-native analytics for website crawls."""
