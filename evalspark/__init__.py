"""Spark-native evaluation analytics: sources, column functions, operators and streaming jobs."""
