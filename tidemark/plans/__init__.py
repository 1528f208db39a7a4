"""Whole runs, the registered queries and their SQL twins."""
