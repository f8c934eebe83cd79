"""Arithmetic that gives null where a result is not defined, instead of an error or an infinity."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for a null or zero b."""
    return F.try_divide(a, b)


def log_ratio(a: Column, b: Column) -> Column:
    """ln(a / b); null unless a / b is above zero."""
    return F.log(F.try_divide(a, b))
