"""Queries over the star tables, each beside the SQL that must give the same rows."""
