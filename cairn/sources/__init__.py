"""Readers, writers and inspection of datasets."""
