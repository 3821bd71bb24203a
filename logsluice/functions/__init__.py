"""Column functions: times, text, numbers, user agents and regular expressions."""
