"""Relational, windowed, pattern and keyed operators over batch DataFrames."""
