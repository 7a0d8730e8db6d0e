"""Operators for preparing and searching training text. Nothing outside this subpackage imports it."""
