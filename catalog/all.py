"""Importing this module registers every query."""

from catalog import beyond, columns, frames, models, tables  # noqa: F401
