"""Shortlist rule and hydration of the shortlisted posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.text import fold

#: The scores that a post needs, alone and with the highest labels.
MIN_SCORE, RESCUE_SCORE, TOP_LABEL = 0.80, 0.75, 3


def shortlisted(min_score: float = MIN_SCORE, rescue: float = RESCUE_SCORE) -> Column:
    top = (F.col("relevance") == TOP_LABEL) & (F.col("value") == TOP_LABEL) & (F.col("preliminary_score") >= rescue)
    return ~F.col("skip") & ((F.col("preliminary_score") >= min_score) | top)


def shortlist(scored: DataFrame) -> DataFrame:
    """Shortlisted posts by score, community and id."""
    return scored.where(shortlisted()).orderBy(F.desc("preliminary_score"), fold(F.col("subreddit")), "post_id")


def hydrate(listed: DataFrame, posts: DataFrame) -> DataFrame:
    """``(stage_b, post)`` structs: each shortlisted row with its post, null where it wasn't found."""
    whole = posts.select(F.col("id").alias("id__"), F.struct(*posts.columns).alias("post"))
    return listed.select(F.struct(*listed.columns).alias("stage_b")).join(whole, F.col("stage_b.post_id") == F.col("id__"), "left").select("stage_b", "post")


def missing_ids(listed: DataFrame, posts: DataFrame) -> DataFrame:
    """Shortlisted ids without a post."""
    return listed.select("post_id").join(posts.select(F.col("id").alias("post_id")), "post_id", "left_anti")


def unexpected_ids(listed: DataFrame, posts: DataFrame) -> DataFrame:
    """Ids of posts that nobody asked for."""
    return posts.select(F.col("id").alias("post_id")).join(listed.select("post_id"), "post_id", "left_anti")


def check_hydrated(items: DataFrame, expected: int | None = None) -> DataFrame:
    """``items`` as they are; raises if the count differs, an id repeats, or a struct is missing."""
    found = items.agg(F.count("*").alias("n"), F.countDistinct("stage_b.post_id").alias("ids"), F.count_if(F.col("stage_b").isNull() | F.col("post").isNull()).alias("holes")).first()
    if expected is not None and found["n"] != expected:
        raise ValueError(f"{found['n']} items, not {expected}")
    if found["holes"]:
        raise ValueError(f"{found['holes']} items lack a part")
    if found["ids"] != found["n"]:
        raise ValueError("an id repeats")
    return items
