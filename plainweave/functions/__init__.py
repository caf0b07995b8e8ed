"""Column functions: text cleaning, tokenisation, namespaces and display names."""
