"""Column functions: text, addresses, phones, urls, names and html."""
