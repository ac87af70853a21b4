"""Readers and writers of graph files."""
