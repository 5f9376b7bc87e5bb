"""Spark-native analytics for auditing large text and source-code corpora."""
