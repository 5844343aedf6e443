"""Functions of the vault engine."""
