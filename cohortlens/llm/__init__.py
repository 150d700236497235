"""Operators for preparing language-model training data: formatting, filtering, dedup, packing."""
