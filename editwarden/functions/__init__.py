"""Column expressions. All of them are built-in Spark expressions; there is no Python UDF."""
