"""prunescan: statistics-aware Parquet scans and data-processing operators on PySpark."""
