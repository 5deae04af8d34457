"""Reading vectors, storing encoded tables."""
