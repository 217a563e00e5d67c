"""Operators on arriving report rows."""
