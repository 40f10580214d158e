"""Operators of a training-data pipeline over text tables; nothing outside this folder imports it."""
