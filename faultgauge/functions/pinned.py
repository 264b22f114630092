"""A way to have an expensive step computed once."""

from pyspark.sql import Column, functions as F


def pinned(value: Column) -> Column:
    """The same value, tied to the task that computes it.

    The optimizer merges projections and pushes filters below them by writing the inner expressions
    out again in the outer ones. Over text measures that repeats costly work and lets plans grow
    without bound. It leaves alone a step with a column like this one.
    """
    return F.when(F.spark_partition_id() >= 0, value)
