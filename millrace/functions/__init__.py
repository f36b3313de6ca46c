"""Scalar functions, aggregates and operators of the dialect as Spark columns."""
