"""DataFrame operators: everything here maps DataFrames to DataFrames."""
