"""Mapping of the driver's tables to the library's inputs, queries and SQL."""
