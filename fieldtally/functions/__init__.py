"""Column expressions: text, dates, numbers and map projection."""
