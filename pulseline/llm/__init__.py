"""Preparing text for language-model training: counting, sharding, packing, duplicates, filters."""
