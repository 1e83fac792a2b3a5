"""Column functions: calendar fields, keys and labels."""
