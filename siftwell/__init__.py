"""Spark-native retrieval, evaluation and corpus analytics: sets of questions against sets of chunks, all as DataFrame plans."""
