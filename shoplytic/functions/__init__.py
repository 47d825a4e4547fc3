"""Column expressions shared by the operators; all built from Spark SQL functions."""
