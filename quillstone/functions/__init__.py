"""Column functions: text, dates, amounts, validation, comparison and files."""
