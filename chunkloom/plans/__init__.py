"""Whole jobs composed from the operators, and the registry of runnable queries."""
