"""Geometry as column expressions, and as numpy for what expressions cannot say."""
