"""Readers, test fixtures over the star schema, and writers."""
