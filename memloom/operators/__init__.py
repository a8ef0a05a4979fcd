"""Relational, graph and set-similarity operators; each takes and returns DataFrames."""
