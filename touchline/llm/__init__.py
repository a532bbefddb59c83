"""Training-data operators.  Nothing else in the library imports this package."""
