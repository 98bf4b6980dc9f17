"""Strandworks: a PySpark-native engine for scoring, de-duplicating, ranking and selecting sequences."""
