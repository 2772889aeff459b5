"""Column expressions: no DataFrame, no action, only built-in Spark functions."""
