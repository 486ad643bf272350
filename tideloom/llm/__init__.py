"""Operators for preparing training text: counting, filtering, deduplication, scanning and mixing."""
