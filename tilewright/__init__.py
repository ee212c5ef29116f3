"""Tile detection, block tensors and run analytics as Spark jobs."""
