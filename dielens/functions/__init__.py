"""Column expressions and shuffle patterns shared by the operators."""
