"""Operators for training-data pipelines: formatting, filtering, de-duplication, search, mixing, sharding.

Nothing else in the library imports this package.
"""
