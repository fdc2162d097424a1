"""The SQL dialect: text to syntax tree to DataFrame."""
