"""streaming of the contract engine."""
