"""Preparation of training text: scans, filters, near-duplicates, mixing, packing and sharding."""
