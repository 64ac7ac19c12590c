"""Rule tables: fixed values that the operators turn into literal columns or broadcast tables."""
