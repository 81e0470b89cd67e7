"""Terrain operators on DataFrames of cells."""
