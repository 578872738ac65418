"""Column functions: text, dates, money, similarity."""
