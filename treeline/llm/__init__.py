"""Operators of a training-data pipeline; optional, nothing else in the library imports them."""
