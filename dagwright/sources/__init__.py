"""Graph files."""
