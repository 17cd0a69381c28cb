"""Column and aggregate expressions; everything here stays in the JVM."""
