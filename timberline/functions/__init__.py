"""Column-building functions: text, filters, line parsing and field extraction."""
