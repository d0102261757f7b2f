"""Raster and experiment analytics on Spark."""
