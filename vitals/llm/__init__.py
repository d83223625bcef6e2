"""Operators that prepare training text: extraction, near copies, quality, language,
secrets, shards, benchmark overlap, packing, repeated passages and URL filters."""
