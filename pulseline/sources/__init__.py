"""Readers for tables, feeds and rule configuration."""
