"""Spark-native network dismantling and heuristic-search analytics."""
