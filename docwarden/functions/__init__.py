"""Column functions and skew-safe building blocks shared by the operators."""
