"""Operators that prepare text for training: archives, filters, near duplicates, mixing, shards."""
