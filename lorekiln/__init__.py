"""Lorekiln: a Spark-native news-corpus analytics engine."""
