"""Operators on transactions, snapshot graphs, windows and scores: DataFrame in, DataFrame out."""
