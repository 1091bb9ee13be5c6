"""Operators: DataFrame in, DataFrame out; the series key is the column symbol."""
