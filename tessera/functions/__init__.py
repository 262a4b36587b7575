"""What values mean: in Python for single rows, as columns for tables."""
