"""Expressions with the types that an operator, not a column, decides on."""
