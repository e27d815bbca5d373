"""Operators on raster, feature and point tables; each takes and returns DataFrames."""
