"""Operators on DataFrames of chapters, pairs, mappings and model replies."""
