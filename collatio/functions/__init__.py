"""Column functions: normalisation, numerals, similarity, identifiers."""
