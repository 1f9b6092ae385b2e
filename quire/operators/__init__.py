"""Relational operators over page tables."""
