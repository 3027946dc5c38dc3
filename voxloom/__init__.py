"""Voxloom: Spark-native analytics of tiled three-dimensional image acquisitions."""
