"""Operators of the vault engine."""
