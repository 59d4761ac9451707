"""Spark-native geospatial dataset engine: DataFrame in, DataFrame out."""
