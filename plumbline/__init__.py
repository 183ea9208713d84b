"""Evidence analytics on Spark: DataFrame operators, queries and their SQL twins."""
