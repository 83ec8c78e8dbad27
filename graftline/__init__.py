"""Attributed graphs, graph rewriting and typed hierarchies on Spark DataFrames."""
