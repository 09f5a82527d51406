"""Operators for preparing training text: filters, counts, duplicates, mixing, models and packing."""
