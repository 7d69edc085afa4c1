"""Spark-native cross-sectional signal engine."""
