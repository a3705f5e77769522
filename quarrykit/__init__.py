"""A PySpark engine for searching versioned source files and checking statements against them."""
