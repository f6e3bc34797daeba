"""Operators for preparing training data: mixing, sharding, quality, secrets, packing, near-duplicates."""
