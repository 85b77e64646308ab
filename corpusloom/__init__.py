"""Spark-native analytics for citation-grounded document collections."""
