"""Grids, tables, rasters and vector layers, and the files they come from."""
