"""Sources of the vault engine."""
