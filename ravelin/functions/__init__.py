"""Column expressions over vectors and metadata."""
