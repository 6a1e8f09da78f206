"""Column functions: expressions from column to column, without joins or actions."""
