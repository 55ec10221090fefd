"""Proximity graphs, single-linkage clustering and their evaluation as Spark DataFrames."""
