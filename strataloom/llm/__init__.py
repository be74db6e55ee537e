"""Operators of a large training-data pipeline. Nothing outside this folder imports it."""
