"""Expressions over rows: the scripting language, SQL functions, and how numbers are written."""
