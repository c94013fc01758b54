"""Reading and writing: line JSON, whole books, catalogues, upserts and rebuilds."""
