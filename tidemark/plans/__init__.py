"""Composed jobs, and the queries that the driver entry registers."""
