"""Midranks, global row numbers, spread samples, batches and keyed upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brinewell.plans.lineage import cut, small


def midrank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the mean 0-based position of ``value`` among its ties within ``keys``, over n - 1; 1.0 where n is 1.

    Ranks come from the counts of distinct values, which partial aggregation
    shrinks before any shuffle, so a key with most of the rows is no hot window.
    Rows with a null value rank first, as one tie.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("ties__"))
    ordered = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first())
    whole = W.partitionBy(*keys)
    before = F.coalesce(F.sum("ties__").over(ordered.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("ties__").over(whole)
    rank = F.when(n == 1, F.lit(1.0)).otherwise((before + (F.col("ties__") - 1) / 2) / F.nullif(n - 1, F.lit(0)))
    ranks = counts.select(*keys, value, rank.alias(out))
    names = [*keys, value]
    right = ranks.select(*(F.col(k).alias(f"{k}__r") for k in names), out)
    same = F.lit(True)
    for k in names:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__r"))
    return df.join(right, same, "left").drop(*(f"{k}__r" for k in names))


def with_row_number(df: DataFrame, order: Sequence[Column], out: str = "ord") -> DataFrame:
    """Add a 0-based global row number without bringing all rows to one task.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus the sizes of the partitions before, of which there are few.
    Equal rows share a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.select("*", F.spark_partition_id().alias("part__"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place__")), "ranged")
    sizes = placed.groupBy("part__").agg(F.count("*").alias("n__"))
    bases = sizes.select("part__", F.coalesce(F.sum("n__").over(W.orderBy("part__").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base__"))
    return placed.join(small(bases), "part__").withColumn(out, F.col("base__") + F.col("place__")).drop("part__", "place__", "base__", "n__")


def spread_sample(df: DataFrame, count: int, order: Sequence[Column]) -> DataFrame:
    """``count`` rows spread evenly over the given order, with their place in ``ord``.

    Place ``round(p * (n - 1) / (count - 1))``, half to even, for p from 0 on;
    the middle row for a count of 1; all rows where there are no more.
    """
    if count <= 0:
        raise ValueError("the sample must have at least one row")
    numbered = with_row_number(df, order)
    n = numbered.count()
    if count >= n:
        return numbered
    places = df.sparkSession.range(count)
    at = F.lit(n // 2).cast("long") if count == 1 else F.bround(F.col("id") * F.lit(n - 1) / F.lit(count - 1)).cast("long")
    return numbered.join(small(places.select(at.alias("ord"))), "ord")


def batches(df: DataFrame, size: int, order: Sequence[Column]) -> DataFrame:
    """Add ``ord`` and ``batch_id``: contiguous batches of ``size`` rows in the given order, the last maybe shorter."""
    if size <= 0:
        raise ValueError("a batch must have at least one row")
    return with_row_number(df, order).withColumn("batch_id", F.floor(F.col("ord") / size).cast("long"))


def run_limit(n: int, batch_size: int, max_posts: int | None = None, max_batches: int | None = None) -> tuple[int, bool]:
    """Rows that a bounded run takes, and whether it leaves any."""
    limit = min([n, *(x for x in (max_posts, None if max_batches is None else batch_size * max_batches) if x is not None)])
    return limit, limit < n


def upsert(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``, in the place (``order``) of the first."""
    last = F.max_by(F.struct(*(F.col(c) for c in df.columns if c not in (key, order))), order)
    return df.groupBy(key).agg(last.alias("last__"), F.min(order).alias(order)).select(key, order, "last__.*")


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right.select(key).distinct(), key, "left_anti")
