"""Checks of the Spark results against SQL on another engine."""
