"""Lodestone: hybrid retrieval (BM25 + dense + RRF) over DataFrames."""
