"""Mixing sources to target weights under a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear
between knots. Its integral is the source's cumulative demand for words; a
document's place in its source's order, as a share of that demand, is turned
back into a training position by inverting the integral, and documents are
range-sorted by position.

Places are running sums of sizes in an order hashed from id and text. They are
made in two levels (sums by hash bucket, then within a bucket), with a number of
buckets that follows the number of rows, so a source with a third of all rows is
spread like any other, and so are rows without an id. Rows that agree in id,
text and source are counted before they are shuffled and take places in a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brinewell.plans.lineage import cut, small

#: Weights of the sources in the order of their names, repeating, and the weight schedule of each: knots (time, weight).
WEIGHTS = (5, 2, 1)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Rows of a hash bucket, about, and hexadecimal digits of a bucket at most.
BUCKET_ROWS, DIGITS = 256, 6


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``(source, source_size, kind, target)`` from rows of ``(source, size)``.

    Sources by code point, null last, take the weights in turn and share
    ``percent`` of all sizes; a target stops at ``most`` times its source's
    size and the excess is shared again by weight. In the order of size per
    weight the capped sources come first, so one pass of running sums finds
    them. There is one row per source here, sums made before, so windows
    without a partition stay small: a million sources are some 100 MB.
    """
    big = "decimal(38,0)"
    kinds = F.expr("(row_number() over (order by source asc nulls last) - 1) % " + str(len(weights)))
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("kind", kinds)
    by_source = by_source.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("kind") + 1).cast("int")).cast(big))
    order = W.orderBy(F.col("source_size") / F.col("weight").cast("double"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    size = F.col("source_size").cast(big)
    left = (F.sum(size).over(W.partitionBy()) * percent - F.coalesce(F.sum(size).over(before), F.lit(0)) * (100 * most)).cast(big)
    ranked = by_source.withColumns({"left": left, "others": F.sum("weight").over(after).cast(big)})
    ranked = ranked.withColumn("capped", (size * F.col("others") * (100 * most)).cast(big) <= (F.col("weight") * F.col("left")).cast(big))
    # The first source that is not capped fixes the share of itself and of all after it.
    share = F.min_by(F.struct("left", "others"), F.struct("place")).over(W.partitionBy("capped"))
    ranked = ranked.withColumn("place", F.row_number().over(order)).withColumn("share", share)
    free = (F.col("weight") * F.col("share.left")).cast(big).cast("double") / (F.col("share.others") * 100).cast(big).cast("double")
    return ranked.select("source", "source_size", "kind", F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(free).alias("target"))


def inverse_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which a schedule has used ``share`` (0..1) of its integral."""
    pieces, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        pieces.append((total, t0, t1, w0, (w1 - w0) / (t1 - t0)))
        total += (w0 + w1) / 2 * (t1 - t0)
    out = F.lit(float(knots[-1][0]))
    for start, t0, t1, w0, slope in reversed(pieces):
        need = share * total - start
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + need * (2 * slope), F.lit(0.0)))
        step = F.coalesce(need * 2 / F.nullif(root + w0, F.lit(0.0)), F.lit(0.0))
        time = F.least(F.lit(t1), step + t0) if t0 else F.least(F.lit(t1), step)
        out = time if (start, t0, t1, w0, slope) == pieces[-1] else F.when(share * total < start + (2 * w0 + slope * (t1 - t0)) / 2 * (t1 - t0), time).otherwise(out)
    return out


def _rank(id_col: str, text_col: str, seed: int) -> Column:
    """Hashed order of the rows of a source; also tells rows of different id or text apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary")), F.lit(f":{seed}")).cast("binary"))


def _source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def _groups(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], percent: int, most: int, seed: int) -> DataFrame:
    """``(source_key, rank, id, source, size, n, place, source_size, kind, target)``: n equal rows and the place of the first."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col).cast("string")).alias("size"), _rank(id_col, text_col, seed).alias("rank"))
    slim = cut(slim.groupBy("id", "source", "size", "rank").agg(F.count("*").alias("n")), "sizes")
    digits = min(DIGITS, max(1, math.ceil(math.log(max(slim.count(), 2) / BUCKET_ROWS, 16))))
    targets = cut(source_targets(slim.select("source", (F.col("size") * F.col("n")).alias("size")), weights, percent, most), "targets")
    placed = slim.withColumns({"bucket": F.substring("rank", 1, digits), "source_key": _source_key("source")})
    words = F.col("size") * F.col("n")
    sums = placed.groupBy("source_key", "bucket").agg(F.sum(words).alias("bucket_size"))
    earlier = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("base"))
    within = W.partitionBy("source_key", "bucket").orderBy("rank", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("own", F.coalesce(F.sum(words).over(within), F.lit(0))).join(sums, ["source_key", "bucket"])
    keyed = targets.withColumn("source_key", _source_key("source")).drop("source")
    placed = placed.join(small(keyed), "source_key")
    return placed.select("source_key", "rank", "id", "source", "size", "n", (F.col("base") + F.col("own")).alias("place"), "source_size", "kind", "target")


def _taken(groups: DataFrame, schedules: Sequence[Sequence[tuple[float, float]]], most: int) -> DataFrame:
    """Each of the n rows of the groups on its own, with ``copies``, ``taken`` and ``positions``."""
    rows = groups.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    middle = (F.col("place") + F.col("k") * F.col("size")).cast("double") + F.col("size") / 2
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumns({"middle": middle, "whole": whole})
    extra = F.when(F.col("middle") <= F.col("target") - F.col("whole") * F.col("source_size"), 1).otherwise(0)
    rows = rows.withColumn("copies", F.least(F.lit(most), F.col("whole") + extra).cast("int"))

    def position(copy: Column) -> Column:
        share = F.least(F.lit(1.0), F.coalesce((copy * F.col("source_size") + F.col("middle")) / F.nullif("target", F.lit(0.0)), F.lit(0.0)))
        out = inverse_schedule(share, schedules[0])
        for kind in range(1, len(schedules)):
            out = F.when(F.col("kind") == kind, inverse_schedule(share, schedules[kind])).otherwise(out)
        return out

    copies = F.filter(F.array(*(F.when(F.col("copies") > k, position(F.lit(k))) for k in range(most))), lambda x: x.isNotNull())
    return rows.withColumns({"taken": (F.col("copies") * F.col("size")).cast("long"), "positions": copies})


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, percent: int = 150, most: int = 2, seed: int = 0) -> DataFrame:
    """``(id, source, size, source_size, target, copies, taken, positions)`` sorted by first position.

    A document is taken ``copies`` times (0 to ``most``): the whole number in
    target / source_size, and once more for the first documents of the source's
    hashed order until the target is met, so a source misses its target by half
    a document at most. ``positions`` holds the training time of each copy;
    documents that are not taken come last with none.

    Null texts have size 0; a null source is a source of its own, after the
    others; repeated rows are each taken on their own, in an order set by id
    and text, so reruns agree; null ids are ordered by their texts. An empty
    table gives no rows. Other columns, of whatever name, are not read.
    """
    rows = _taken(_groups(docs, id_col, text_col, source_col, weights, percent, most, seed), schedules, most)
    slim = cut(rows.select("id", "source", "size", "source_size", "target", "copies", "taken", "positions"), "mix")
    return slim.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "id")


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, percent: int = 150, most: int = 2, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` once per copy that the mix takes, range-sorted by ``position``, with ``copy``.

    Rows that agree in id, text and source are each taken on their own, with
    the other columns of one of them. Columns of ``docs`` named ``copy``,
    ``position`` or like those of the mix are replaced or left out by the caller.
    """
    names = [c for c in docs.columns if c not in ("copy", "position")]
    groups = cut(_groups(docs, id_col, text_col, source_col, weights, percent, most, seed), "groups")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), _source_key(source_col).alias("source_key"), _rank(id_col, text_col, seed).alias("rank"))
    # Joined and then thinned, both by one partitioning and sort order.
    met = whole.join(groups.where("n > 0"), ["source_key", "rank"]).dropDuplicates(["source_key", "rank"])
    rows = _taken(met.drop("id", "source"), schedules, most).select("row", "rank", "k", F.posexplode("positions").alias("copy", "position"))
    rows = rows.orderBy("position", "rank", "k", "copy")
    return rows.select("row.*", (F.col("k") * most + F.col("copy")).cast("int").alias("copy"), "position")
