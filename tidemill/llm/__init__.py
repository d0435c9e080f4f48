"""Training-data operators: language, safety, quality, deduplication, mixing and packing.

Nothing else in the library imports this subpackage; it may be removed whole.
"""
