"""Queries over the driver's tables: each derives its input from whole tables and has an SQL twin."""
