"""Operators: DataFrame in, DataFrame out; fitted objects hold a bounded number of values."""
