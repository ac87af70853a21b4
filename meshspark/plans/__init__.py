"""Run parameters and graphs derived from tables."""
