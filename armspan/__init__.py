"""Spark DataFrame operators for running, measuring and comparing workloads."""

__version__ = "0.1.0"
