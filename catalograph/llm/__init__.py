"""Operators of a training-data pipeline: sharding, packing, deduplication, filters, token files. Nothing else imports them."""
