"""Readers, writers and the binding of the generic test tables to listings."""
