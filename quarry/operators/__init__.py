"""Operators over rasters, blocks and experiment cells; importing a module registers its queries."""
