"""A PySpark engine for auditing text and files, and for preparing text corpora."""
