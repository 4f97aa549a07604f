"""Readers, writers and table-shaped views of files, archives and PDF objects."""
