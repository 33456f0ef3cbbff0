"""Spark-native analytics for evidence reviews: DataFrame in, DataFrame out."""
