"""Part of the lexgrove package."""
