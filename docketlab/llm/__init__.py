"""Operators a large-scale training-data pipeline needs. Nothing else in the library imports this."""
