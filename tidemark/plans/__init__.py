"""Whole queries: operators put together over the tables, and the same in SQL."""
