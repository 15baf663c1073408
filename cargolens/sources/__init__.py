"""Readers, writers and the adapter from test tables to the data model."""
