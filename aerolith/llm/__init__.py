"""Operators for large text corpora: dedup, scoring, tokenising, search and packing.

Nothing outside this subpackage imports it; it can be deleted without touching the rest.
"""
