"""Query language, its compilation to Columns, and plan helpers."""
