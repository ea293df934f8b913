"""Code-intelligence queries and training-data operators as Spark plans."""
