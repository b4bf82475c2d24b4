"""Readers, writers and the views over the supplied test tables."""
