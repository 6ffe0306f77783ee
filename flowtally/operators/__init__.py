"""Operators over tables of records."""
