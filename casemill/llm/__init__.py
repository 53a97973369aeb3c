"""Operators of a training-data pipeline: cleaning, near duplicates, mixing, packing, archives and search."""
