"""Corpus operators: store, diff, traversal, validation, forms, redaction, logs, layout."""
