"""Warehouse order-line analytics as Spark DataFrame programs."""
