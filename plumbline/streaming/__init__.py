"""Incremental versions of some operators."""
