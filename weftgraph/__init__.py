"""Code-structure graphs as DataFrames: ``nodes`` and ``edges``, and the operators over them."""
