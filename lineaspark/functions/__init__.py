"""Column expressions, loops and small kernels that the operators share."""
