"""Spark-native positional full-text retrieval."""
