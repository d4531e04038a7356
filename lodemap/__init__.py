"""Spark-native code knowledge-graph analytics."""
