"""Operators over DataFrames: typed data sets, sufficient statistics, independence tests, graph frames."""
