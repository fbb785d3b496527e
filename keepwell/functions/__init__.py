"""Column functions and shared predicates."""
