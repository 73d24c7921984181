"""Column functions and exact-text helpers."""
