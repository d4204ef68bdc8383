"""Operators of a training-data pipeline: one module an operator, queries and SQL in :mod:`.queries`."""
