"""DataFrame operators: every function takes and returns DataFrames."""
