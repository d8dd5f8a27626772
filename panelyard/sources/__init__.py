"""Readers, writers and the panel derived from the star-schema tables."""
