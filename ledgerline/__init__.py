"""Spark-native analytics for publication-aware observation panels."""
