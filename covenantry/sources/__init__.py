"""sources of the contract engine."""
