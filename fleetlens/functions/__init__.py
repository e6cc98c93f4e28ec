"""Column expressions behind the operators. Built-in Spark expressions only."""
