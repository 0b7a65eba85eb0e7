"""Queries over the test tables, one or more for each operator, with SQL where SQL can express them."""
