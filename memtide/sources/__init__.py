"""Readers, writers and embedding connectors."""
