"""Annotations that arrive over time."""
