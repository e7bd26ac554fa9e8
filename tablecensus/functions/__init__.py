"""Scalar functions as Spark ``Column`` expressions."""
