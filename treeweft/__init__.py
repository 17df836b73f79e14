"""Spark-native analytics for tree-structured count data."""
