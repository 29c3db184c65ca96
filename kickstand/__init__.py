"""Fleet-operations analytics for shared vehicles, as plain Spark DataFrame jobs."""
