"""Operators of a training-data pipeline: filters, packing, search, near
duplicates, tokenising.  Nothing else in the library imports this package."""
