"""Queries over the test tables, each with the SQL that gives the same rows."""
