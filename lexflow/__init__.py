"""Spark-native processing of document and mail corpora."""
