"""Operators over DataFrames; NumPy kernels where an operator is iterative or numeric."""
