"""Scalar functions: native expressions where Spark has the semantics, Arrow UDFs where it lacks them."""
