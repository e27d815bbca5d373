"""Column functions and small geometry kernels."""
