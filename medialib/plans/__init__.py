"""Whole jobs composed from operators, and the registry of runnable queries."""
