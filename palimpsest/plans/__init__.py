"""Helpers that shape plans: table access, materialisation, session settings."""
