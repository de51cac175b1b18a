"""Spark-native analytics over graph patterns: triples, patterns, plans, statistics."""
