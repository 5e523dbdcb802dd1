"""Column functions: text, arrays, labels and JSON."""
