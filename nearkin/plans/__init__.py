"""Whole plans put together from the operators: the model, and the registered queries with their SQL."""
