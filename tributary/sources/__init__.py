"""Reading and writing tables."""

from .tables import append, catalog_table, create_if_missing, overwrite, read_csv, read_parquet, rows, upsert

__all__ = ["append", "catalog_table", "create_if_missing", "overwrite", "read_csv", "read_parquet", "rows", "upsert"]
