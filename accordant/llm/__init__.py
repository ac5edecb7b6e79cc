"""Operators for preparing training data: mixing, filtering, de-duplication, scoring and packing."""
