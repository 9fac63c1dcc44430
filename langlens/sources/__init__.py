"""Sources of files."""
