"""Operators of a training-data pipeline. Nothing else in lodestone imports this package."""
