"""Spark-native memory retrieval and temporal knowledge-graph analytics."""
