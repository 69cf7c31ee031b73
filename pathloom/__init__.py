"""Search and analytics over very large file inventories, as plain Spark plans."""
