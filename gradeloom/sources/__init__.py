"""Readers of the JSON shapes and writers of run outputs."""
