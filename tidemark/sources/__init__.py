"""Readers, writers and vendor-frame normalisation."""
