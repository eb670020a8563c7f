"""Retail-banking portfolio analytics as Spark DataFrame operators."""
