"""Readers, writers and file inventories."""
