"""Operators for training-data pipelines: tokenising, deduplication, filtering and scanning of text tables.

Nothing outside this package imports it; removing the folder leaves the rest of the library intact.
"""
