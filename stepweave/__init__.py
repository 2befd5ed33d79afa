"""Process mining over tool-call trails, expressed as Spark DataFrame operations."""
