"""Streaming of the catalog library."""
