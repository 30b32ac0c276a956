"""Column expressions that the operators share. All are built-in functions; none is a Python UDF."""
