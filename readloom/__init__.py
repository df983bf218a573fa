"""Spark-native analytics over pairwise read alignments, plus training-data operators in ``llm``."""
