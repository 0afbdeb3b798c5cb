"""Interpretive text analytics on Spark: features, facets, phrases and feature clusters as DataFrames."""

__version__ = "0.1.0"
