"""Readers: the flight table, CSV files and lookups."""
