"""Arithmetic on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Column) -> Column:
    return values.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)


def norm(values: Column) -> Column:
    return F.sqrt(dot(values, values))


def distance(left: Column, right: Column) -> Column:
    squares = F.zip_with(left, right, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, value: total + value))


def cosine(left: Column, right: Column) -> Column:
    return F.coalesce(F.try_divide(dot(left, right), norm(left) * norm(right)), F.lit(0.0))


def literal_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(value)) for value in values])
