"""Column expressions: text cleaning and pair features."""
