"""Relational and kernel operators; every one takes and returns DataFrames."""
