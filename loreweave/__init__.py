"""Loreweave: analytics over a knowledge vault, written for Spark."""
