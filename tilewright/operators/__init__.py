"""Operators over tiles, regions, detections and records, as functions from DataFrames to DataFrames."""
