"""Column functions: text, ratings, labels and schema helpers."""
