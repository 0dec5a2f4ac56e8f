"""Spark-native curation and evaluation of instruction-tuning data."""
