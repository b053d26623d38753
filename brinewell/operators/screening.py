"""Exclusion rules, engagement floor and engagement scores of posts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.text import fold, matches
from brinewell.operators.ranking import midrank
from brinewell.plans.lineage import cut

#: The patterns of the rules.
GIVEAWAY = (r"\b(?:giveaway|give\s+away|sweepstakes)\b",)
SPAM = (
    r"\bbuy\s+(?:reddit\s+)?(?:upvotes?|followers?|subscribers?|likes?)\b",
    r"\bguaranteed\s+(?:traffic|followers?|subscribers?|ranking|rankings)\b",
    r"\b(?:telegram|whatsapp)\b.{0,50}\b(?:dm|message|contact)\b",
    r"\b(?:dm|message|contact)\b.{0,50}\b(?:telegram|whatsapp)\b",
)
ROUTINE = (
    r"\b(?:daily|weekly|monthly|quarterly)\b.{0,50}\b(?:thread|megathread|discussion|questions?|help|hiring|jobs?|showcase|promotion|self[- ]promo)\b",
    r"\b(?:thread|megathread)\b.{0,50}\b(?:daily|weekly|monthly|quarterly)\b",
)
STICKIED = (r"\b(?:megathread|hiring thread|jobs? thread|questions? thread|help thread|self[- ]promo)\b",)
#: Words of which every match of the patterns holds one.
GIVEAWAY_WORDS, SPAM_WORDS = ("give", "sweepstakes"), ("buy", "guaranteed", "telegram", "whatsapp")


@dataclass(frozen=True)
class ScreeningConfig:
    removed_states: frozenset[str] = frozenset({"removed", "deleted"})
    exclude_spam: bool = True
    exclude_giveaways: bool = True
    exclude_routine: bool = True
    score_weight: float = 0.5
    comment_weight: float = 0.5
    min_score: int = 4
    min_comments: int = 3


def exclusion(config: ScreeningConfig = ScreeningConfig()) -> Column:
    """The first rule that excludes a post, or null."""
    # No pattern starts or ends with white space, so texts needn't be stripped first.
    text, title = F.concat("title", F.lit("\n"), "body"), F.col("title")
    rule = F.when(F.col("removed_state").isin(*sorted(config.removed_states)), F.col("removed_state")) if config.removed_states else F.when(F.lit(False), F.lit(""))
    if config.exclude_giveaways:
        rule = rule.when(matches(text, *GIVEAWAY, needs=GIVEAWAY_WORDS), "giveaway")
    if config.exclude_spam:
        rule = rule.when(matches(text, *SPAM, needs=SPAM_WORDS), "obvious_spam")
    if config.exclude_routine:
        rule = rule.when(matches(title, *ROUTINE) | (F.col("is_stickied") & matches(title, *STICKIED)), "routine_sticky")
    return rule


def label(posts: DataFrame, config: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """Add ``keep`` and ``reason``; every post stays, in one narrow stage without a shuffle."""
    low = ~((F.col("score") >= config.min_score) | (F.col("comment_count") >= config.min_comments))
    allowed = F.when(F.col("is_locked"), "locked_allowed").when(F.col("is_crosspost"), "crosspost_allowed").otherwise("normal")
    rule = F.coalesce(exclusion(config), F.when(low, F.lit("low_engagement")))
    return posts.withColumn("excluded__", rule).select("*", F.col("excluded__").isNull().alias("keep"), F.coalesce("excluded__", allowed).alias("reason")).drop("excluded__")


def score_engagement(labelled: DataFrame, config: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """Add ``score_rank``, ``comment_count_rank`` and ``engagement_score``: midranks among the kept posts of a community, null for others."""
    kept = labelled.where("keep").withColumn("community__", fold(F.col("subreddit")))
    ranked = midrank(midrank(kept, ["community__"], "score", "score_rank"), ["community__"], "comment_count", "comment_count_rank")
    total = config.score_weight + config.comment_weight
    mean = (F.col("score_rank") * config.score_weight + F.col("comment_count_rank") * config.comment_weight) / total
    scored = ranked.withColumn("engagement_score", mean).drop("community__")
    rest = labelled.where(~F.col("keep"))
    return scored.unionByName(rest.withColumns({c: F.lit(None).cast("double") for c in ("score_rank", "comment_count_rank", "engagement_score")}))


def screen(posts: DataFrame, config: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """Labels and engagement scores, one row per post. Posts that carry an ``ord`` keep it, for the input order.

    The labelled posts are written once, as ranks and rows both read them.
    """
    return score_engagement(cut(label(posts, config), "labelled"), config)
