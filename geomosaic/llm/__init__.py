"""Training-data operators: one module for each, queries and their SQL in ``queries``."""
