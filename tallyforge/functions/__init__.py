"""Column expressions: dates, text, bands."""
