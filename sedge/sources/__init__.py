"""Readers, writers and file provenance."""
