"""Orrery operators."""
