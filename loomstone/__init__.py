"""Document-catalog analytics on Spark: prepare, keep, search, rank, retain, audit and measure text catalogs."""
