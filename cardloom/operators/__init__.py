"""Relational operators of the domain: DataFrame in, DataFrame out."""
