"""Column functions: bucket ranges and scalar helpers."""
