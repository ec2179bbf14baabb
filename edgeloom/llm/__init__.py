"""Operators for preparing text corpora: cleaning, deduplication, packing, scoring."""
