"""operators of the contract engine."""
