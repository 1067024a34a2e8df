"""Readers and writers of vector file formats."""
