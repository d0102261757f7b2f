"""Column functions: integer coding, prediction, bands."""
