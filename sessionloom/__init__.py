"""Clickstream session analytics as Spark DataFrame operators."""
