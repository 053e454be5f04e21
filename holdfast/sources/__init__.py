"""Readers and writers for the file formats the engine exchanges."""
