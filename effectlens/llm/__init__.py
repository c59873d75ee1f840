"""Training-data operators: ten corpus operators and the modules that register them as queries."""
