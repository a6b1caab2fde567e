"""Filters, joins of index and entries, and writes as DataFrame transformations."""
