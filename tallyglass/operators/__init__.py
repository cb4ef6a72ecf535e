"""Operators on results: measures by dimension, matching, hardness, reports, chart data."""
