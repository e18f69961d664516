"""Column expressions: identity keys, text, numbers, dates and geography."""
