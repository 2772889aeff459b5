"""Table schemas, readers, writers and the built-in category catalogue."""
