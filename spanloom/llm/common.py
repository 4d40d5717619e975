"""Helpers that the corpus operators share: the shared folder and joins that no key can skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.plans.session import new_folder, shared_dir, stored

__all__ = ["HOT_KEYS", "lookup", "new_folder", "shared_dir", "text_of", "written"]

#: Rows of the broadcast side of :func:`lookup`; a key outside it holds at most 1/HOT_KEYS of the rows.
HOT_KEYS = 1000


#: What is computed once lies in the run's folder; spanloom.plans.session.clear_run deletes it.
written = stored


def text_of(column: str = "text") -> Column:
    """The column as a string, null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lookup(left: DataFrame, groups: DataFrame, key: str, values: list[str], size: str, spread: Column, hot_keys: int | None = None, fits: Column | None = None) -> DataFrame:
    """left with the columns `values` of `groups` (one row a key), null where there is none.

    A plain join deals all rows of one key to one task. Here the `hot_keys` (HOT_KEYS) keys with the most
    rows (`size`) are broadcast - that many rows at most, whatever the input - and their
    rows of `left` are dealt out by `spread` instead. `spread` has to be a string that is
    unique enough to spread rows and never equals a key. Where values have no bound of their own,
    `fits` says which rows of `groups` are small enough to be broadcast; the rest are joined, and
    a partition with most of the rows is split by Spark's skew join.
    """
    slim = groups.select(key, *dict.fromkeys([*values, size]))
    small = slim if fits is None else slim.where(fits)
    hot = small.orderBy(F.desc(size), key).limit(hot_keys or HOT_KEYS).select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot"))
    cold = slim.select(F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold"))
    near = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    near = near.withColumn("_deal", F.when(F.col("_hot").isNotNull() | F.col(key).isNull(), spread).otherwise(F.col(key)))
    both = near.join(cold, F.col("_deal") == F.col("_cold_key"), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return both.select(*[left[c] for c in left.columns], *[found[v].alias(v) for v in values])
