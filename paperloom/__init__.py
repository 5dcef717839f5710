"""Spark-native literature search, deduplication and triage engine."""
