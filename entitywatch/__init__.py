"""Behavioural access-log analytics as Spark DataFrame operators."""
