"""Column functions over sequences, qualities and CIGARs."""
