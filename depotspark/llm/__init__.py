"""Operators for large text corpora; each module holds one operator and its thin contract query."""
