"""Column functions over numbers and arrays; all of them stay in the JVM."""
