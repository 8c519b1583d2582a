"""Retail product analytics expressed as Spark DataFrame operations."""
