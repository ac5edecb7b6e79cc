"""Column functions: row-local expressions that stay inside the JVM."""
