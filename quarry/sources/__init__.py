"""Scans: tables, and rasters, blocks and experiment cells made from them."""
