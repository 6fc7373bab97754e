"""Operators for large training-data pipelines; each module can be used on its own."""
