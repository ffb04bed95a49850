"""Batch and stream operators over event DataFrames."""
