"""Composed plans: the engine facade and the registered queries."""
