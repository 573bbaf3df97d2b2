"""Relational, text and graph operators; every function takes and returns DataFrames or Columns."""
