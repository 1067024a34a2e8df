"""Scalar functions on vectors."""
