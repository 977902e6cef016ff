"""Runnable jobs over given tables, and the queries that run them."""
