"""Scalar functions of columns."""
