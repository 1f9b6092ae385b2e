"""Derived tables and report plans."""
