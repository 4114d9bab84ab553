"""cardloom: analytics for collectible catalogues, and training-data operators, on PySpark."""
