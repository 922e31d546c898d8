"""Append-only, totally ordered event logs as Spark DataFrames and streams."""
