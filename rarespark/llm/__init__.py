"""Operators of a large training-data pipeline over ``documents``, ``pages`` and ``conversations``."""
