"""Column builders: one expression per feature or scalar, all evaluated in the JVM."""
