"""Column expressions and grouped helpers; all of them stay JVM-side."""
