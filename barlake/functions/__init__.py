"""Column expressions and partition-safe window helpers."""
