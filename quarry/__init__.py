"""Spark-native analytics over source-code indexes, task queues and text corpora."""
