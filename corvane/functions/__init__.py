"""Column functions: text, vectors, semi-structured values, scalars."""
