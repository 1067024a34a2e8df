"""Operators on tables of vectors."""
