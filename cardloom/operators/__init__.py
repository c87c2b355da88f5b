"""Table-to-table operators, each a function of DataFrames returning a DataFrame."""
