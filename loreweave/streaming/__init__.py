"""Streaming of the vault engine."""
