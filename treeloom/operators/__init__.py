"""Relational operators over files and chunks."""
