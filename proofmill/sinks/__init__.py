"""Where databases go: JSON, Parquet, SQLite, reports, and edits of their own sources."""
