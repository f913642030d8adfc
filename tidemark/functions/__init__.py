"""Column functions: payload reading, display values, small text helpers."""
