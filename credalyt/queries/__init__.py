"""Registered queries: each module has QUERIES and ORACLES by name."""
