"""Spark-native operators over tiled rasters and text corpora."""
