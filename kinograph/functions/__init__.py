"""Column algebra that the operators are made of."""
