"""Column functions: every one works on a single row and stays in the JVM."""
