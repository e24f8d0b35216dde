"""Hierarchical clustering, annotation and corpus analytics as Spark DataFrames."""
