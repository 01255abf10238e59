"""Column-level functions. Everything here is a native expression: no UDF."""
