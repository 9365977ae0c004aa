"""Helpers that shape physical plans: lineage cuts, session defaults, table access."""
