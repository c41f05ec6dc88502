"""Column helpers; every one is a native expression."""
