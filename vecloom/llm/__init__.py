"""Operators for preparing large text corpora, each usable on its own DataFrames.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries, the operators' modules their SQL.
"""
