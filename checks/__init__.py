"""Queries over the driver tables, one or more per operator, with SQL to compare them with."""
