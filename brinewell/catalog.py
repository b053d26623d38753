"""Registered queries of the engine and their DuckDB equivalents.

The tables have no posts, so a deterministic view makes them of ``documents``
and ``pages``; the same formulas are in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.text import fold
from brinewell.functions.times import iso_utc, week_end, week_start
from brinewell.functions.urls import TRACKING_KEYS, canonical_url
from brinewell.operators import classify, dedup, ranking, shortlist
from brinewell.operators.screening import GIVEAWAY, ROUTINE, SPAM, STICKIED, label, screen
from brinewell.sources.normalize import normalize, post_type, removed_state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts made of documents; every branch of the rules occurs."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    d = F.col("doc_id")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    is_self = d % 3 == 0
    docs = docs.withColumn("page_id", F.when(~is_self, d % pages.count())).join(pages, "page_id", "left")
    title = F.when(d % 41 == 0, "Weekly Hiring Thread").when(d % 37 == 0, "Big giveaway today").when(d % 43 == 0, "Guaranteed followers now").otherwise(F.substring("text", 1, 60))
    body = F.when(d % 29 == 0, "[removed]").when(d % 31 == 0, "[deleted]").otherwise(F.col("text"))
    parent = F.when((d % 13 == 0) & (d > 0), F.concat(F.lit("d"), (d - 1).cast("string")))
    own = docs.select(
        d.alias("ord"), F.concat(F.lit("d"), d.cast("string")).alias("id"), F.col("source").alias("subreddit"), title.alias("title"), body.alias("body"), (d * 7919 % 53).alias("score"), (d * 104729 % 17).alias("comment_count"),
        is_self.alias("is_self"), (d % 23 == 0).alias("is_locked"), (d % 2 == 0).alias("is_stickied"), parent.alias("crosspost_parent"), parent.isNotNull().alias("is_crosspost"),
        F.when(~is_self, F.col("url")).alias("external_url"), F.when(~is_self, F.regexp_extract("url", "^https?://([^/?#]+)", 1)).alias("domain"),
    )
    return own.withColumn("removed_state", removed_state(F.col("title"), F.col("body")))


def labelled_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified and scored posts; the classes are formulas of the id."""
    kept = screen(posts(spark, sf_dir)).where("keep")
    labels = kept.select("ord", "id", "subreddit", "crosspost_parent", "external_url", "engagement_score", (F.col("ord") % 4).alias("relevance"), (F.floor(F.col("ord") / 4) % 4).alias("value"), (F.col("ord") % 19 == 0).alias("skip"))
    return labels.withColumn("preliminary_score", classify.preliminary_score(F.col("engagement_score"), F.col("relevance"), F.col("value"))).withColumnRenamed("id", "post_id")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_posts(spark, sf_dir)
    left = F.struct("post_id", "subreddit", "preliminary_score", "relevance", "value", "engagement_score")
    return rows.select(left.alias("stage_b"), F.struct(F.col("post_id").alias("id"), "external_url", "crosspost_parent").alias("post"))


@_query
def stage_a_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(posts(spark, sf_dir)).select("id", "keep", "reason")


@_query
def stage_a_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(posts(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("n"))


@_query
def stage_a_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screen(posts(spark, sf_dir)).select("ord", "id", "keep", "reason", "score_rank", "comment_count_rank", "engagement_score")


@_query
def event_midrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.midrank(_read(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_type"], "value", "rank")


@_query
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = screen(posts(spark, sf_dir)).where("keep").select("id", "subreddit", "engagement_score")
    return ranking.spread_sample(kept, 200, [F.col("engagement_score"), fold(F.col("subreddit")), F.col("id")]).select("ord", "id")


@_query
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = label(posts(spark, sf_dir)).where("keep").select("id", "subreddit")
    return ranking.batches(kept, 25, [fold(F.col("subreddit")), F.col("id")]).select("ord", "id", "batch_id")


@_query
def stage_b_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = spark.createDataFrame([("SRC3", "a note")], "community string, note string")
    return classify.build_inputs(screen(posts(spark, sf_dir)), notes=notes).drop("ord")


@_query
def stage_b_payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.batches(classify.build_inputs(screen(posts(spark, sf_dir))).drop("ord"), 25, [fold(F.col("subreddit")), F.col("post_id")])
    made = classify.payloads(rows)
    read = F.from_json("payload", "posts array<struct<post_id: string, title: string>>")
    return made.select("batch_id", F.array_join(read["posts"]["post_id"], ",").alias("ids"), F.size("post_ids").cast("long").alias("n"))


@_query
def classified_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair, validation and scoring of the offline classifier's answers (no SQL: a classifier is a function)."""
    screened = screen(posts(spark, sf_dir))
    rows = ranking.batches(classify.build_inputs(screened).drop("ord"), 25, [fold(F.col("subreddit")), F.col("post_id")])
    scored = classify.score_classified(classify.classify(rows, classify.offline_classifier), screened)
    return classify.usage_totals(scored)


@_query
def preliminary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_posts(spark, sf_dir).select("post_id", "engagement_score", "relevance", "value", "skip", "preliminary_score")


@_query
def shortlisted_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.shortlist(labelled_posts(spark, sf_dir)).select("post_id", "subreddit", "preliminary_score")


@_query
def classification_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents as answers, ids a hundred further on as questions, so that some are missing and some unexpected."""
    reason = F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, "toxic")).otherwise(F.when(F.col("doc_id") % 7 == 0, "why"))
    answers = _read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("post_id"), (F.col("toxic") == 1).alias("skip"), reason.alias("skip_reason"))
    asked = _read(spark, sf_dir, "documents").select((F.col("doc_id") + 100).cast("string").alias("post_id"))
    return classify.violations(answers, asked)


@_query
def pending_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _read(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("post_id"))
    inputs = label(posts(spark, sf_dir)).where("keep").select(F.col("id").alias("post_id"), "subreddit")
    return ranking.missing_keys(inputs, done, "post_id")


def _hydrated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The shortlist, and as fetched posts those of documents that have a label; the others are missing."""
    listed = shortlist.shortlist(labelled_posts(spark, sf_dir)).select("post_id", "preliminary_score")
    labelled = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord")).distinct()
    found = posts(spark, sf_dir).join(labelled, "ord", "left_semi").select("id", "score", "external_url")
    return listed, found


@_query
def hydrate_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.hydrate(*_hydrated(spark, sf_dir)).select("stage_b.post_id", "stage_b.preliminary_score", F.col("post").isNull().alias("missing"), F.col("post.score").alias("score"))


@_query
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.missing_ids(*_hydrated(spark, sf_dir))


@_query
def unexpected_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.unexpected_ids(*_hydrated(spark, sf_dir))


@_query
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", canonical_url("url").alias("canonical"))


@_query
def dedup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.group_items(_items(spark, sf_dir)).select("component", "post_id")
    lowest = found.groupBy("component").agg(F.min("post_id").alias("first_id"), F.count("*").alias("size"))
    return found.join(lowest, "component").select("post_id", "first_id", "size")


@_query
def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat(x[k], F.lit("="), F.array_join(x["post_ids"], "+"))), ";")
    links = F.array_join(F.transform("crosspost_links", lambda x: F.concat(x["parent_id"], F.lit(">"), x["post_id"])), ";")
    return dedup.dedup_groups(_items(spark, sf_dir)).select(
        "group_id", "representative_post_id", F.array_join("member_post_ids", ",").alias("members"), F.col("size").cast("long").alias("size"), "is_duplicate_group", F.array_join("duplicate_signals", ",").alias("signals"),
        pairs("shared_external_urls", "normalized_url").alias("urls"), links.alias("links"), pairs("shared_crosspost_parents", "parent_id").alias("parents"),
    )


@_query
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.summarize(dedup.dedup_groups(_items(spark, sf_dir)))
    return out.select(*(F.col(c).cast("long").alias(c) for c in out.columns))


@_query
def dedup_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.top_groups(dedup.dedup_groups(_items(spark, sf_dir))).select("representative_post_id", F.col("size").cast("long").alias("size"), "representative_score")


@_query
def post_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit(".PNG"))).when(F.col("page_id") % 7 == 0, F.concat("url", F.lit(".webm"))).when(F.col("page_id") % 11 == 0, None).otherwise(F.col("url"))
    domain = F.when(F.col("page_id") % 13 == 0, "i.redd.it").when(F.col("page_id") % 17 == 0, "V.redd.it")
    hint = F.when(F.col("page_id") % 19 == 0, "hosted:video")
    return pages.select("page_id", post_type(F.col("page_id") % 3 == 0, url, domain, hint).alias("post_type"))


@_query
def removed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    body = F.when(d % 5 == 0, " [Removed]\n").when(d % 7 == 0, "[ removed by moderator ]").when(d % 11 == 0, "[deleted]").otherwise(F.col("text"))
    title = F.when(d % 3 == 0, "[DELETED]").otherwise(F.lit("x"))
    return _read(spark, sf_dir, "documents").select("doc_id", removed_state(title, body).alias("state"))


@_query
def week_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by local week; driver timestamps have no zone and are read as UTC."""
    at = F.col("ts").cast("timestamp")
    rows = _read(spark, sf_dir, "events").select(week_start(at).alias("s"), week_end(at).alias("e"))
    hours = ((F.unix_timestamp("e") - F.unix_timestamp("s")) / 3600).cast("long")
    return rows.groupBy("s", "e").agg(F.count("*").alias("n")).select(F.col("s").cast("timestamp_ntz").alias("week_start"), hours.alias("hours"), "n")


@_query
def iso_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", iso_utc(F.col("ts").cast("timestamp")).alias("text"))


@_query
def community_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))


@_query
def ordered_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total order of posts (community, score, id) as row numbers."""
    rows = posts(spark, sf_dir).select("id", "subreddit", "score")
    return ranking.with_row_number(rows, [fold(F.col("subreddit")), F.col("score"), F.col("id")]).select("ord", "id")


@_query
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return ranking.upsert(rows, "user_id", "event_id")


@_query
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked for by ``benchmark`` item ids, some twice and some unknown, in request order."""
    from brinewell.sources.http import lookup

    most = _read(spark, sf_dir, "documents").count() * 3 // 2
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.concat(F.lit("t3_d"), (F.col("item_id") * 7919 % most).cast("string")).alias("id"))
    return lookup(posts(spark, sf_dir).select("id", "score"), asked).select("pos", "id", "score")


@_query
def normalized_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows made of pages, typed."""
    p = F.col("page_id")
    text = lambda c: c.cast("string")
    none = F.lit(None)
    raw = _read(spark, sf_dir, "pages").select(
        F.concat(F.when(p % 2 == 0, "t3_").otherwise(""), F.lit("p"), text(p)).alias("id"), F.when(p % 9 != 0, "Pages").alias("subreddit"), F.when(p % 4 != 0, "a title").alias("title"), F.when(p % 6 == 0, "[removed]").alias("selftext"),
        F.when(p % 3 == 0, F.concat(F.lit("/r/x/"), text(p))).when(p % 3 == 1, F.lit("https://x.org/y")).otherwise("").alias("permalink"), F.when(p % 5 != 0, text(p * 3)).alias("score"), F.when(p % 7 != 0, text(p)).alias("num_comments"),
        text(p + 1).alias("comment_count"), F.when(p % 2 == 0, "0.5").alias("upvote_ratio"), F.when(p % 2 == 0, text(p * 1000)).otherwise("2026-01-02T03:04:05Z").alias("created_utc"), F.col("url"), F.when(p % 8 == 0, "self.Pages").otherwise("").alias("domain"),
        F.when(p % 10 == 0, "flair").otherwise("").alias("link_flair_text"), F.when(p % 12 == 0, "t3_abc").otherwise("").alias("crosspost_parent"), F.when(p % 18 == 0, "def").alias("crosspost_parent_id"), none.cast("string").alias("post_hint"),
        none.cast("boolean").alias("is_self"), (p % 2 == 0).alias("over_18"), none.cast("boolean").alias("stickied"), (p % 16 == 0).alias("locked"),
    )
    out = normalize(raw, "test", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return out.withColumn("created_at", iso_utc(F.col("created_at"))).drop("fetched_at")


_POSTS = f"""
n AS (SELECT count(*) AS n FROM pages),
base AS (SELECT doc_id AS ord, 'd' || doc_id AS id, source AS subreddit,
  CASE WHEN doc_id % 41 = 0 THEN 'Weekly Hiring Thread' WHEN doc_id % 37 = 0 THEN 'Big giveaway today' WHEN doc_id % 43 = 0 THEN 'Guaranteed followers now' ELSE substr(text, 1, 60) END AS title,
  CASE WHEN doc_id % 29 = 0 THEN '[removed]' WHEN doc_id % 31 = 0 THEN '[deleted]' ELSE text END AS body, (doc_id * 7919) % 53 AS score, (doc_id * 104729) % 17 AS comment_count,
  doc_id % 3 = 0 AS is_self, doc_id % 23 = 0 AS is_locked, doc_id % 2 = 0 AS is_stickied, CASE WHEN doc_id % 13 = 0 AND doc_id > 0 THEN 'd' || (doc_id - 1) END AS crosspost_parent, p.url AS external_url
  FROM documents LEFT JOIN pages p ON doc_id % 3 <> 0 AND p.page_id = doc_id % (SELECT n FROM n)),
posts AS (SELECT *, crosspost_parent IS NOT NULL AS is_crosspost, regexp_extract(external_url, '^https?://([^/?#]+)', 1) AS domain,
  CASE WHEN lower(trim(body, ' ' || chr(10))) = '[deleted]' THEN 'deleted' WHEN lower(trim(body, ' ' || chr(10))) = '[removed]' THEN 'removed' ELSE 'none' END AS removed_state FROM base),
labelled AS (SELECT *, CASE WHEN removed_state <> 'none' THEN removed_state WHEN regexp_matches(title || chr(10) || body, '{GIVEAWAY[0]}', 'i') THEN 'giveaway'
  WHEN {' OR '.join(f"regexp_matches(title || chr(10) || body, '{p}', 'i')" for p in SPAM)} THEN 'obvious_spam'
  WHEN {' OR '.join(f"regexp_matches(title, '{p}', 'i')" for p in ROUTINE)} OR is_stickied AND regexp_matches(title, '{STICKIED[0]}', 'i') THEN 'routine_sticky'
  WHEN NOT (score >= 4 OR comment_count >= 3) THEN 'low_engagement' WHEN is_locked THEN 'locked_allowed' WHEN is_crosspost THEN 'crosspost_allowed' ELSE 'normal' END AS reason FROM posts),
kept AS (SELECT *, reason IN ('normal', 'locked_allowed', 'crosspost_allowed') AS keep FROM labelled)"""


def _midrank(key: str, value: str) -> str:
    n = f"count(*) OVER (PARTITION BY {key})"
    return f"CASE WHEN {n} = 1 THEN 1.0e0 ELSE (rank() OVER (PARTITION BY {key} ORDER BY {value}) - 1 + (count(*) OVER (PARTITION BY {key}, {value}) - 1) / 2.0e0) / ({n} - 1) END"


_SCORED = f"""{_POSTS},
ranked AS (SELECT *, {_midrank('lower(subreddit)', 'score')} AS score_rank, {_midrank('lower(subreddit)', 'comment_count')} AS comment_count_rank FROM kept WHERE keep),
engaged AS (SELECT *, (score_rank * 0.5e0 + comment_count_rank * 0.5e0) / 1.0e0 AS engagement_score FROM ranked),
scored AS (SELECT *, id AS post_id, (engagement_score * 0.4e0 + ((relevance + value) / 6.0e0) * 0.6e0) / (0.4e0 + 0.6e0) AS preliminary_score FROM (SELECT *, ord % 4 AS relevance, (ord // 4) % 4 AS value, ord % 19 = 0 AS skip FROM engaged)),
short AS (SELECT * FROM scored WHERE NOT skip AND (preliminary_score >= 0.8e0 OR (relevance = 3 AND value = 3 AND preliminary_score >= 0.75e0)))"""

_KEYS = ", ".join(f"'{k}'" for k in sorted(TRACKING_KEYS))


def _canonical(url: str) -> str:
    bare = f"regexp_replace(regexp_replace({url}, '#.*$', ''), '^https?://', '')"
    base = f"split_part({bare}, '?', 1)"
    host = f"regexp_replace(lower(split_part({base}, '/', 1)), '^www\\.', '')"
    path = f"coalesce(nullif(rtrim(substr({base}, length(split_part({base}, '/', 1)) + 1), '/'), ''), '/')"
    query = f"array_to_string(list_sort(list_filter(string_split(split_part({bare}, '?', 2), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ({_KEYS}))), '&')"
    return f"{host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


_GROUPS = f"""{_SCORED},
m AS (SELECT *, CASE WHEN external_url IS NOT NULL THEN {_canonical('external_url')} END AS url FROM scored),
hubs AS (SELECT post_id, 'p:' || post_id AS hub FROM m UNION ALL SELECT post_id, 'p:' || crosspost_parent FROM m WHERE crosspost_parent IS NOT NULL UNION ALL SELECT post_id, 'u:' || url FROM m WHERE url IS NOT NULL),
near AS (SELECT DISTINCT a.post_id AS a, b.post_id AS b FROM hubs a JOIN hubs b USING (hub)),
reach AS (SELECT post_id AS a, post_id AS b FROM m UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
comp AS (SELECT a AS post_id, min(b) AS first_id FROM reach GROUP BY a),
g AS (SELECT m.*, first_id FROM m JOIN comp USING (post_id)),
u AS (SELECT first_id, string_agg(url || '=' || ids, ';' ORDER BY url) AS urls FROM (SELECT first_id, url, string_agg(post_id, '+' ORDER BY post_id) AS ids FROM g WHERE url IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
c AS (SELECT first_id, string_agg(crosspost_parent || '=' || ids, ';' ORDER BY crosspost_parent) AS parents FROM (SELECT first_id, crosspost_parent, string_agg(post_id, '+' ORDER BY post_id) AS ids FROM g WHERE crosspost_parent IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL),
groups AS (SELECT first_id, 'dedup-' || substr(sha256(string_agg(post_id, chr(10) ORDER BY post_id)), 1, 12) AS group_id, list(post_id ORDER BY preliminary_score DESC, relevance DESC, value DESC, engagement_score DESC, lower(subreddit), post_id) AS ids,
  max(preliminary_score) AS representative_score, count(*) AS size, coalesce(string_agg(crosspost_parent || '>' || post_id, ';' ORDER BY crosspost_parent, post_id), '') AS links, list(crosspost_parent) AS all_parents FROM g GROUP BY first_id)"""

_WITH = "WITH RECURSIVE "
ORACLES |= {
    "stage_a_labels": f"{_WITH}{_POSTS} SELECT id, keep, reason FROM kept",
    "stage_a_reason_counts": f"{_WITH}{_POSTS} SELECT reason, count(*) AS n FROM kept GROUP BY reason",
    "stage_a_engagement": f"{_WITH}{_SCORED} SELECT k.ord, k.id, k.keep, k.reason, score_rank, comment_count_rank, engagement_score FROM kept k LEFT JOIN engaged e USING (id)",
    "event_midrank": f"SELECT event_id, event_type, value, {_midrank('event_type', 'value')} AS rank FROM events",
    "spread_sample": f"{_WITH}{_SCORED}, o AS (SELECT id, row_number() OVER (ORDER BY engagement_score, lower(subreddit), id) - 1 AS ord, count(*) OVER () AS n FROM engaged) SELECT ord, id FROM o WHERE n <= 200 OR ord IN (SELECT CAST(round_even(p * ((SELECT max(n) FROM o) - 1) / 199.0e0, 0) AS BIGINT) FROM range(200) t(p))",
    "batch_assignment": f"{_WITH}{_POSTS} SELECT ord, id, ord // 25 AS batch_id FROM (SELECT id, row_number() OVER (ORDER BY lower(subreddit), id) - 1 AS ord FROM kept WHERE keep)",
    "stage_b_inputs": f"{_WITH}{_POSTS} SELECT id AS post_id, subreddit, trim(title, ' ' || chr(10)) AS title, substr(trim(body, ' ' || chr(10)), 1, 300) AS body_excerpt, CASE WHEN NOT is_self THEN domain END AS external_domain, CASE WHEN subreddit = 'src3' THEN 'a note' END AS subreddit_note FROM kept WHERE keep",
    "stage_b_payload_ids": f"{_WITH}{_POSTS} SELECT ord // 25 AS batch_id, string_agg(id, ',' ORDER BY ord) AS ids, count(*) AS n FROM (SELECT id, row_number() OVER (ORDER BY lower(subreddit), id) - 1 AS ord FROM kept WHERE keep) GROUP BY 1",
    "preliminary_score": f"{_WITH}{_SCORED} SELECT post_id, engagement_score, relevance, value, skip, preliminary_score FROM scored",
    "shortlisted_posts": f"{_WITH}{_SCORED} SELECT post_id, subreddit, preliminary_score FROM short",
    "classification_violations": """WITH a AS (SELECT CAST(doc_id AS VARCHAR) AS post_id, toxic = 1 AS skip, CASE WHEN toxic = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'toxic' END WHEN doc_id % 7 = 0 THEN 'why' END AS r FROM labels),
e AS (SELECT CAST(doc_id + 100 AS VARCHAR) AS post_id FROM documents)
SELECT post_id, 'duplicate' AS problem FROM a GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT post_id, 'missing' FROM e WHERE post_id NOT IN (SELECT post_id FROM a)
UNION ALL SELECT DISTINCT post_id, 'unexpected' FROM a WHERE post_id NOT IN (SELECT post_id FROM e) UNION ALL SELECT post_id, 'no_reason' FROM a WHERE skip AND r IS NULL UNION ALL SELECT post_id, 'needless_reason' FROM a WHERE NOT skip AND r IS NOT NULL""",
    "pending_anti_join": f"{_WITH}{_POSTS} SELECT id AS post_id, subreddit FROM kept WHERE keep AND ord NOT IN (SELECT doc_id FROM labels)",
    "hydrate_left_join": f"{_WITH}{_SCORED} SELECT post_id, preliminary_score, NOT ord IN (SELECT doc_id FROM labels) AS missing, CASE WHEN ord IN (SELECT doc_id FROM labels) THEN score END AS score FROM short",
    "missing_ids": f"{_WITH}{_SCORED} SELECT post_id FROM short WHERE NOT ord IN (SELECT doc_id FROM labels)",
    "unexpected_ids": f"{_WITH}{_SCORED} SELECT id AS post_id FROM posts WHERE ord IN (SELECT doc_id FROM labels) AND id NOT IN (SELECT post_id FROM short)",
    "url_normalize": f"SELECT page_id, {_canonical('url')} AS canonical FROM pages",
    "dedup_components": f"{_WITH}{_GROUPS} SELECT post_id, g.first_id, size FROM g JOIN groups USING (first_id)",
    "dedup_groups": f"""{_WITH}{_GROUPS} SELECT group_id, ids[1] AS representative_post_id, array_to_string(ids, ',') AS members, size, size > 1 AS is_duplicate_group,
concat_ws(',', CASE WHEN urls IS NOT NULL THEN 'same_external_url' END, CASE WHEN list_has_any(ids, all_parents) THEN 'crosspost_parent_in_group' END, CASE WHEN parents IS NOT NULL THEN 'shared_crosspost_parent' END) AS signals,
coalesce(urls, '') AS urls, links, coalesce(parents, '') AS parents FROM groups LEFT JOIN u USING (first_id) LEFT JOIN c USING (first_id)""",
    "dedup_summary": f"{_WITH}{_GROUPS} SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS input_posts, count(*) AS groups, count(*) FILTER (size = 1) AS standalone_groups, count(*) FILTER (size > 1) AS duplicate_groups, CAST(coalesce(sum(size - 1), 0) AS BIGINT) AS posts_merged_as_duplicates, coalesce(max(size), 0) AS largest_group_size FROM groups",
    "dedup_top_groups": f"{_WITH}{_GROUPS} SELECT ids[1] AS representative_post_id, size, representative_score FROM groups WHERE size > 1 ORDER BY size DESC, representative_score DESC, ids[1] LIMIT 10",
    "post_types": """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'text' WHEN page_id % 13 = 0 OR page_id % 5 = 0 THEN 'image' WHEN page_id % 19 = 0 OR page_id % 17 = 0 OR page_id % 7 = 0 THEN 'video' WHEN page_id % 11 = 0 THEN 'other' ELSE 'link' END AS post_type FROM pages""",
    "removed_states": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR (doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 = 0) THEN 'deleted' WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'removed' ELSE 'none' END AS state FROM documents",
    "week_bucket": """WITH w AS (SELECT date_trunc('week', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Stockholm') AS m FROM events)
SELECT ((CAST(m AS TIMESTAMP) AT TIME ZONE 'Europe/Stockholm') AT TIME ZONE 'UTC') AS week_start, CAST(date_diff('hour', (CAST(m AS TIMESTAMP) AT TIME ZONE 'Europe/Stockholm') AT TIME ZONE 'UTC', ((CAST(m AS TIMESTAMP) + INTERVAL 7 DAY) AT TIME ZONE 'Europe/Stockholm') AT TIME ZONE 'UTC') AS BIGINT) AS hours, count(*) AS n FROM w GROUP BY ALL""",
    "iso_texts": "SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), '\\.0+Z$', 'Z') AS text FROM events",
    "community_counts": "SELECT source, count(*) AS n FROM documents GROUP BY source",
    "ordered_posts": f"{_WITH}{_POSTS} SELECT row_number() OVER (ORDER BY lower(subreddit), score, id) - 1 AS ord, id FROM posts",
    "upsert_last_wins": "SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "id_lookup": f"{_WITH}{_POSTS} SELECT item_id AS pos, id, score FROM benchmark JOIN posts ON id = 'd' || (item_id * 7919 % (SELECT count(*) * 3 // 2 FROM documents))",
    "normalized_posts": """WITH r AS (SELECT *, page_id AS p, 'p' || page_id AS id, CASE WHEN page_id % 9 <> 0 THEN 'Pages' ELSE '' END AS subreddit, page_id % 8 = 0 AS is_self FROM pages)
SELECT id, subreddit, CASE WHEN p % 4 <> 0 THEN 'a title' ELSE '' END AS title, CASE WHEN p % 6 = 0 THEN '[removed]' ELSE '' END AS body,
CASE WHEN p % 3 = 0 THEN 'https://www.reddit.com/r/x/' || p WHEN p % 3 = 1 THEN 'https://x.org/y' ELSE 'https://www.reddit.com/r/' || subreddit || '/comments/' || id || '/' END AS permalink, 'test' AS provider,
CASE WHEN p % 5 <> 0 THEN p * 3 ELSE 0 END AS score, CASE WHEN p % 7 <> 0 THEN p ELSE p + 1 END AS comment_count, CASE WHEN p % 5 <> 0 THEN p * 3 ELSE 0 END AS score_at_fetch, CASE WHEN p % 2 = 0 THEN 0.5e0 END AS upvote_ratio,
CASE WHEN p % 2 = 0 THEN strftime(make_timestamp(p * 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE '2026-01-02T03:04:05Z' END AS created_at, url AS external_url, CASE WHEN is_self THEN 'self.Pages' END AS domain, CASE WHEN p % 10 = 0 THEN 'flair' END AS flair,
CASE WHEN p % 12 = 0 THEN 'abc' WHEN p % 18 = 0 THEN 'def' END AS crosspost_parent, is_self, p % 2 = 0 AS is_nsfw, false AS is_stickied, p % 16 = 0 AS is_locked, p % 12 = 0 OR p % 18 = 0 AS is_crosspost,
CASE WHEN is_self THEN 'text' ELSE 'link' END AS post_type, CASE WHEN p % 6 = 0 THEN 'removed' ELSE 'none' END AS removed_state FROM r""",
}
