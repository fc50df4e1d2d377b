"""Queries over the example tables, with the SQL that gives the same rows."""
