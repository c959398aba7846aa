"""Orrery: a Spark-native engine for risk-prioritised inspection analytics."""
