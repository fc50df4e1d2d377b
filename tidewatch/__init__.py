"""Telemetry queries and corpus preparation as Spark DataFrame transformations."""
