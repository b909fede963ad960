"""Column functions: text, numbers, markup."""
