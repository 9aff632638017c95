"""Spark jobs that measure large collections of SQL scripts and stored procedures."""
