"""Readers of elevation grids and node-link files."""
