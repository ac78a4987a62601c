"""Column expressions. Everything here runs inside the JVM; there is no UDF."""
