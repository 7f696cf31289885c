"""Spark-native engine for graph-aligned single-cell reads."""
