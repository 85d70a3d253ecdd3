"""Spark-native event, retrieval, graph and data-preparation analytics."""
