"""Scalar functions on columns that several operators share."""
