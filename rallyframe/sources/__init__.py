"""Readers of tables, delivered files and artifacts."""
