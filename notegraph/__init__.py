"""notegraph: note vaults and typed tables as queryable records, on Spark DataFrames."""
