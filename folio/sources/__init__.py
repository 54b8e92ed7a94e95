"""Readers: XML article records, dimension tables, caches, and stand-ins for remote services."""
