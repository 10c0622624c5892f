"""Column functions; all are built from Spark's own and stay in the JVM."""
