"""Orrery functions."""
