"""Column expressions: item names, texts, numerals, similarity, commands."""
