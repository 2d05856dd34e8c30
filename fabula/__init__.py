"""Spark-native analytics over long-form text."""
