"""Terrain drainage analytics as Spark jobs."""
