"""Repertoire analytics on Spark: relational operators, features, statistics, models and metrics."""
