"""Column expressions shared by the operators. Everything here stays in the JVM."""
