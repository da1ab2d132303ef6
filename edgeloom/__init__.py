"""Privacy-safe linkage of usage events to billing records, built on Spark DataFrames."""
