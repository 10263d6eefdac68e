"""Spark-native preparation, oversampling and judging of rare-event training data."""
