"""Operators for preparing text corpora; nothing outside this subpackage imports it."""
