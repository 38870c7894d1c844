"""Delta plans and their application."""
