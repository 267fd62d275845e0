"""Spark-native search over the version history of text collections."""
