"""Predictive-maintenance analytics as Spark DataFrame functions, SQL functions and streams."""
