"""Readers, writers and schema evolution."""
