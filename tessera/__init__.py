"""Tessera: Spark-native analytics for observation-by-feature count matrices."""
