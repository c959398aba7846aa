"""Orrery sources."""
