"""Building an index, searching it, and measuring searches."""
