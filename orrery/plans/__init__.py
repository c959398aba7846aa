"""Orrery plans."""
