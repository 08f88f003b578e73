"""Longitudinal cohort analytics as Spark DataFrame jobs."""
