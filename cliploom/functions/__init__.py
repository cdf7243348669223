"""Column functions on clips and NumPy kernels."""
