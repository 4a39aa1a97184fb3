"""Readers, column mapping and writers."""
