"""Operators for the preparation of training data; nothing outside this subpackage imports it."""
