"""Scalar functions as Column builders, and the few Arrow UDFs Spark has no built-in for."""
