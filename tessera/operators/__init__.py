"""Relational operators of record linkage; each takes and gives DataFrames."""
