"""Tiled spatial analytics over large rasters and their annotations, on Spark DataFrames."""
