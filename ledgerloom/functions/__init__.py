"""Column expressions: Column in, Column out, evaluated in the JVM."""
