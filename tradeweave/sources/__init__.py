"""Where tables come from and go to: CSV, catalog, JDBC, Parquet warehouse."""
