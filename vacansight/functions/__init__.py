"""Column builders: every cleaning and rounding step as a Spark expression."""
