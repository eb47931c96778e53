"""Spark-native analytics over time-stamped media, transcripts and text corpora."""
