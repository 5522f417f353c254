"""Operators for preparing text corpora: packing, de-duplication, filtering, scoring, encoding."""
