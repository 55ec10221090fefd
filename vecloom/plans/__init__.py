"""Parameters, layered indexes and whole clustering pipelines."""
