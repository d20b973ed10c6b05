"""Operators for the ten record-cleaning problems; nothing outside this subpackage imports it."""
