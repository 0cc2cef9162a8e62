"""Operators: one module per family, each DataFrame in, DataFrame out."""
