"""Readers, writers, path keys and table adapters."""
