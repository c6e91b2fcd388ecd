"""Spark-native analytics over labelled short-text corpora."""
