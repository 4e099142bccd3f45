"""Whole queries: views over the given tables, query shapes, statement runs."""
