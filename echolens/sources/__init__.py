"""Reading and maintaining the product tables."""
