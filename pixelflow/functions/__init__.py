"""Column functions: colour, scoring and rating expressions."""
