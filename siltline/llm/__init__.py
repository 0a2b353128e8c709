"""Operators of a training-data pipeline; nothing else in siltline imports this package."""
