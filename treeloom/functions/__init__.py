"""Scalar and table functions."""
