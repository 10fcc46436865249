"""Operators: DataFrame(s) in, lazy DataFrame out, column names as arguments."""
