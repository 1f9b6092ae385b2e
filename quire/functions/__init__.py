"""Scalar functions: text, embeddings, parameters."""
