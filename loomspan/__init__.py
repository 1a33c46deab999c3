"""Spark-native analytics over dated document corpora."""
