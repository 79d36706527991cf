"""Queries over the tables of a folder, with their SQL twins."""
