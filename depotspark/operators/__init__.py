"""Relational and analytic operators over order lines; each takes and returns DataFrames."""
