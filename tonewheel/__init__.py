"""Spark-native analytics over keyboard label frames, detections, fits and note streams."""
