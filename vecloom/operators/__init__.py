"""Graph, tree and evaluation operators, all from DataFrames to DataFrames."""
