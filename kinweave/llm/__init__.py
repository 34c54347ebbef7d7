"""Operators that prepare records and texts for model training; nothing outside this subpackage imports it."""
