"""Column functions: text, URLs, extraction, dates."""
