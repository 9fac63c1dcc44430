"""Column expressions: paths, shebang lines, text and tokens. All of them are JVM expressions."""
