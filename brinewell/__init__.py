"""Brinewell: a PySpark-native engine for ranking, deduplicating and refining text corpora."""
