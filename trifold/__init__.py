"""A PySpark engine for three-way merges of files and tables, and the state around them."""
