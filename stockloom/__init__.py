"""Retail sales and stock analytics as PySpark DataFrame operators."""
