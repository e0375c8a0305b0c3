"""Operators for preparing training data: filters, near duplicates, packing, shards and audits."""
