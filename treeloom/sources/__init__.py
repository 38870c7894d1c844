"""Readers and codecs."""
