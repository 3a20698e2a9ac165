"""Column factories: every function takes and returns Spark columns."""
