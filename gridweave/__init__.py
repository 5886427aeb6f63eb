"""Spark-native analytics over power-grid scenario tables."""
