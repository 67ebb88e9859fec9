"""Spark-native de-identification and span analytics over large text collections."""
