"""Spark-native operators for series, graphs, sketches, arrays and corpora."""
