"""Column functions: pure expressions that stay inside the JVM unless stated."""
