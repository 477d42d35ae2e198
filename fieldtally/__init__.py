"""Sampling-effort tables from monitoring visits, as Spark DataFrame plans."""
