"""DataFrame operators: one module per concern, each a function of DataFrames."""
