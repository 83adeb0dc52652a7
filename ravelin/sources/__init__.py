"""Reading and writing indexes."""
