"""Scalar kernels: coordinate systems and geometry."""
