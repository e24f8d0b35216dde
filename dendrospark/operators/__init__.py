"""Relational, hierarchy, clustering and quality operators: DataFrames in, DataFrames out."""
