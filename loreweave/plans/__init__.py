"""Plans of the vault engine."""
