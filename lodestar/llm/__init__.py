"""Operators that a training-data pipeline needs; nothing outside this package imports it."""
