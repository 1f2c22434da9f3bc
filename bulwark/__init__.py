"""Guardrail analytics over Spark DataFrames."""
