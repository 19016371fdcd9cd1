"""Readers, writers and metadata of files."""
