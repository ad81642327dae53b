"""Column expressions: text normalisation, edit distances, names and sizes, exact rounding."""
