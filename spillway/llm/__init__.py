"""Training-data operators: one module for each, nothing else in the library imports them."""
