"""Readers and importers that turn files and raw tables into node and object tables."""
