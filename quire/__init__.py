"""Quire: document-layout analytics and alignment on Spark DataFrames."""
