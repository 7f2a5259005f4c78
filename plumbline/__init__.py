"""Reliability analytics as DataFrame expressions, windows, joins and grouped Arrow functions."""
