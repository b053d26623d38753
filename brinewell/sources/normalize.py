"""Raw API rows to typed posts, as one narrow projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.text import SPACE, drop_kind_prefix
from brinewell.functions.times import parse_instant

#: The site that relative permalinks belong to, markers of removed texts, and signs of media.
SITE = "https://www.reddit.com"
DELETED = ("[deleted]",)
REMOVED = ("[removed]", "[ removed by moderator ]", "[removed by moderator]")
IMAGE_HOST, IMAGE_ENDINGS = "i.redd.it", (".jpg", ".jpeg", ".png", ".gif", ".webp")
VIDEO_HOST, VIDEO_ENDINGS = "v.redd.it", (".mp4", ".webm")


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _or_null(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def _ends(c: Column, endings: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for e in endings:
        found = found | c.endswith(e)
    return found


def post_type(is_self: Column, url: Column, domain: Column, hint: Column) -> Column:
    """text, image, video, link or other; the first that applies. Arguments may be null."""
    u, d, h = (F.lower(F.coalesce(c, F.lit(""))) for c in (url, domain, hint))
    image = h.contains("image") | (d == IMAGE_HOST) | u.contains("/gallery/") | _ends(u, IMAGE_ENDINGS)
    video = h.contains("video") | (d == VIDEO_HOST) | _ends(u, VIDEO_ENDINGS)
    return F.when(is_self, "text").when(image, "image").when(video, "video").when(u != "", "link").otherwise("other")


def removed_state(title: Column, body: Column) -> Column:
    """deleted, removed or none, by markers that are the whole title or body."""

    def has(markers: tuple[str, ...]) -> Column:
        whole = rf"(?i)^{SPACE}*(?:" + "|".join(rf"\Q{m}\E" for m in markers) + rf"){SPACE}*\z"
        return body.rlike(whole) | title.rlike(whole)

    return F.when(has(DELETED), "deleted").when(has(REMOVED), "removed").otherwise("none")


def normalize(raw: DataFrame, provider: str, fetched_at: Column | None = None) -> DataFrame:
    """Posts of the schema POST from rows of RAW_POST; other columns are dropped.

    A null id and an instant that can't be read raise an error, as a score that
    is no number does.
    """
    key = F.when(F.col("id").isNull(), F.raise_error(F.lit("a post has no id")).cast("string")).otherwise(drop_kind_prefix(F.col("id")))
    parent = drop_kind_prefix(F.coalesce(_or_null("crosspost_parent"), _or_null("crosspost_parent_id")))
    is_self = F.coalesce(F.col("is_self"), F.lower("domain").startswith("self."), F.lit(False))
    link = _or_null("permalink")
    built = F.concat(F.lit(f"{SITE}/r/"), _or_empty("subreddit"), F.lit("/comments/"), key, F.lit("/"))
    score = F.coalesce(F.col("score").cast("bigint"), F.lit(0).cast("bigint"))
    return raw.select(
        key.alias("id"),
        _or_empty("subreddit").alias("subreddit"),
        _or_empty("title").alias("title"),
        _or_empty("selftext").alias("body"),
        F.coalesce(F.when(link.startswith("/"), F.concat(F.lit(SITE), link)).otherwise(link), built).alias("permalink"),
        F.lit(provider).alias("provider"),
        score.alias("score"),
        F.coalesce(F.col("num_comments"), F.col("comment_count"), F.lit("0")).cast("bigint").alias("comment_count"),
        score.alias("score_at_fetch"),
        F.col("upvote_ratio").cast("double").alias("upvote_ratio"),
        parse_instant(F.col("created_utc")).alias("created_at"),
        (F.current_timestamp() if fetched_at is None else fetched_at).alias("fetched_at"),
        _or_null("url").alias("external_url"),
        _or_null("domain").alias("domain"),
        _or_null("link_flair_text").alias("flair"),
        parent.alias("crosspost_parent"),
        is_self.alias("is_self"),
        *(F.coalesce(F.col(c), F.lit(False)).alias(n) for c, n in (("over_18", "is_nsfw"), ("stickied", "is_stickied"), ("locked", "is_locked"))),
        parent.isNotNull().alias("is_crosspost"),
        post_type(is_self, _or_null("url"), _or_null("domain"), F.col("post_hint")).alias("post_type"),
        removed_state(_or_empty("title"), _or_empty("selftext")).alias("removed_state"),
    )
