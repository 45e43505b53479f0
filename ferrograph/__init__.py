"""Spark analytics for experiment records: relational operators as functions from DataFrame to DataFrame."""
