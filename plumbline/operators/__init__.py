"""Operators over score relations and dataset records."""
