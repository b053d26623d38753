"""Duplicate groups of hydrated posts: a graph of ids, crosspost parents and canonical URLs, and its components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brinewell.functions.text import drop_kind_prefix, fold, strip
from brinewell.functions.urls import canonical_url
from brinewell.operators.components import connected_components
from brinewell.plans.lineage import cut
from brinewell.plans.skew import join_heavy


def check_items(items: DataFrame) -> DataFrame:
    """Items with their checked ``post_id``; raises where a struct or id is missing, blank, unstripped or unequal."""
    a, b = F.col("stage_b.post_id"), F.col("post.id")
    ok = F.coalesce((a == b) & (a != "") & (strip(a) == a), F.lit(False))
    checked = F.when(ok, a).otherwise(F.raise_error(F.concat(F.lit("bad item: "), F.coalesce(a, b, F.lit("null")))).cast("string"))
    return items.withColumn("post_id", checked)


def parent_key(c: Column) -> Column:
    return drop_kind_prefix(F.nullif(strip(c), F.lit("")))


def group_items(items: DataFrame) -> DataFrame:
    """Flat members: ``item`` (row number), ids, canonical URL, parent, sort keys, and ``component``, its least item.

    Items share a group if they share an id, a canonical URL or a crosspost
    parent, or if one is the parent of another. Each such key links its items
    to the least of them, so a popular one costs as many edges as it has items,
    not their square; items that share nothing are no part of the graph.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = check_items(items).select(
        F.monotonically_increasing_id().alias("item"), "post_id", F.col("post.external_url").alias("external_url"), parent_key(F.col("post.crosspost_parent")).alias("parent_id"),
        fold(F.coalesce("stage_b.subreddit", F.lit(""))).alias("community"), zero("stage_b.preliminary_score").cast("double").alias("score"), zero("stage_b.relevance").alias("relevance"),
        zero("stage_b.value").alias("value"), zero("stage_b.engagement_score").cast("double").alias("engagement"), "stage_b", "post",
    )
    rows = cut(rows.withColumn("url", canonical_url("external_url")), "items")  # once, as the function runs in Python
    keys = F.array_compact(F.array(F.concat(F.lit("p:"), "post_id"), F.concat(F.lit("p:"), "parent_id"), F.concat(F.lit("u:"), "url")))
    uses = rows.select("item", F.explode(F.array_distinct(keys)).alias("key"))
    hubs = cut(uses.groupBy("key").agg(F.min("item").alias("least"), F.count("*").alias("uses")).where("uses > 1"), "hubs")
    edges = join_heavy(uses, hubs, ["key"], "uses", "inner").where("item <> least")
    found = cut(connected_components(edges, "item", "least"), "components").withColumnRenamed("node", "item")
    return rows.join(found, "item", "left").withColumn("component", F.coalesce("component", "item"))


def _best() -> list[Column]:
    return [F.desc("score"), F.desc("relevance"), F.desc("value"), F.desc("engagement"), F.asc("community"), F.asc("post_id"), F.asc("item")]


def shared_keys(members: DataFrame) -> DataFrame:
    """For each component with any: the URLs and the parents that two or more of its members share, with their ids in order."""
    urls, parents = (F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("url", "url"), ("parent", "parent_id")))
    keyed = members.select("component", "post_id", F.inline(F.array(urls, parents))).where("key is not null")
    lists = keyed.groupBy("component", "kind", "key").agg(F.array_sort(F.collect_list("post_id")).alias("post_ids")).where(F.size("post_ids") > 1)
    of = lambda kind, name: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(F.col("key").alias(name), "post_ids"))))
    return lists.groupBy("component").agg(of("url", "normalized_url").alias("shared_external_urls"), of("parent", "parent_id").alias("shared_crosspost_parents"))


def dedup_groups(items: DataFrame) -> DataFrame:
    """One row per group, by its representative's score and id, with the whole items of its members in order."""
    members = group_items(items)
    # Sort keys as one struct, so that members are ordered within the group's array.
    order = F.struct((-F.col("score")).alias("a"), (-F.col("relevance")).alias("b"), (-F.col("value")).alias("c"), (-F.col("engagement")).alias("d"), "community", "post_id", "item", "parent_id", "score", "stage_b", "post")
    groups = members.groupBy("component").agg(F.array_sort(F.collect_list(order)).alias("m")).join(shared_keys(members), "component", "left")
    ids = F.col("m.post_id")
    best = F.col("m")[0]
    shared = lambda name, key: F.coalesce(F.col(name), F.array().cast(f"array<struct<{key}:string,post_ids:array<string>>>")).alias(name)
    links = F.array_sort(F.transform(F.filter("m", lambda x: x["parent_id"].isNotNull()), lambda x: F.struct(x["parent_id"].alias("parent_id"), x["post_id"].alias("post_id"))))
    out = groups.select(
        F.concat(F.lit("dedup-"), F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n").cast("binary"), 256), 1, 12)).alias("group_id"),
        best["post_id"].alias("representative_post_id"), best["score"].alias("representative_score"), ids.alias("member_post_ids"), F.size("m").alias("size"), (F.size("m") > 1).alias("is_duplicate_group"),
        shared("shared_external_urls", "normalized_url"), links.alias("crosspost_links"), shared("shared_crosspost_parents", "parent_id"),
        F.struct(best["stage_b"].alias("stage_b"), best["post"].alias("post")).alias("representative"), F.transform("m", lambda x: F.struct(x["stage_b"].alias("stage_b"), x["post"].alias("post"))).alias("members"),
    )
    signals = F.array(
        F.when(F.size(F.array_distinct("member_post_ids")) < F.col("size"), "same_post_id"),
        F.when(F.size("shared_external_urls") > 0, "same_external_url"),
        F.when(F.arrays_overlap("member_post_ids", "crosspost_links.parent_id"), "crosspost_parent_in_group"),
        F.when(F.size("shared_crosspost_parents") > 0, "shared_crosspost_parent"),
    )
    return out.withColumn("duplicate_signals", F.array_compact(signals)).orderBy(F.desc("representative_score"), "representative_post_id")


def members_ranked(members: DataFrame) -> DataFrame:
    """Members of :func:`group_items` with their place in the group, the representative's being 0; for groups too large for an array."""
    return members.withColumn("place", F.row_number().over(W.partitionBy("component").orderBy(*_best())) - 1)


def summarize(groups: DataFrame) -> DataFrame:
    big = F.col("size") > 1
    return groups.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("input_posts"), F.count("*").alias("groups"), F.count_if(~big).alias("standalone_groups"), F.count_if(big).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(big, F.col("size") - 1)), F.lit(0)).alias("posts_merged_as_duplicates"), F.coalesce(F.max("size"), F.lit(0)).alias("largest_group_size"),
    )


def top_groups(groups: DataFrame, n: int = 10) -> DataFrame:
    """The largest duplicate groups; the limit is the feature."""
    return groups.where("is_duplicate_group").orderBy(F.desc("size"), F.desc("representative_score"), "representative_post_id").limit(n)
