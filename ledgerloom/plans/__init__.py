"""Whole runs built from the operators, the test inputs derived from the given tables, and the query list."""
