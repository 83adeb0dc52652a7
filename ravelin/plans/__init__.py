"""The plan language, and the engine's registered queries."""
