"""A relational analytics engine on Spark: a small SQL dialect, versioned tables with snapshot transactions, log recovery."""
