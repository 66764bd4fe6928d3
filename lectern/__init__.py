"""Spark-native engine for long-form text and narration corpora."""
