"""The weekly run, step by step; each step reads the tables of the one before and writes its own.

Tables lie under ``<root>/<step>/week_start=<Monday>``, so that a scan of one
week prunes the others. Small records of a run are JSON documents.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.text import fold
from brinewell.functions.times import ZONE, week_window
from brinewell.operators import classify, dedup, shortlist
from brinewell.operators.ranking import batches, run_limit
from brinewell.operators.screening import ScreeningConfig, screen
from brinewell.plans.lineage import cut
from brinewell.plans.resume import ResumableRun, check_run, expect_count, table_fingerprint
from brinewell.sources.http import Transport, scan_window
from brinewell.sources.normalize import normalize
from brinewell.sources.schemas import RAW_POST

VERSION = 1


def _place(root: str, step: str, week: str) -> str:
    return f"{root.rstrip('/')}/{step}/week_start={week}"


def _record(spark: SparkSession, path: str, data: dict) -> None:
    text = json.dumps(data, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _monday(week: date | str | None) -> str:
    return week_window(week)[0].date().isoformat()


def fetch_week(spark: SparkSession, root: str, transport: Transport, communities: Sequence[str], week: date | str | None = None, provider: str = "web", expected_communities: int | None = None) -> dict:
    """Posts of all communities in a local week, in order of community, time and id; the record of the run is returned and written."""
    expect_count(len(communities), expected_communities)
    start, end, start_utc, end_utc = week_window(week)
    monday, began = start.date().isoformat(), time.perf_counter()
    rows, errors = scan_window(spark, transport, communities, start_utc, end_utc)
    raw = rows.select(F.from_json("row", RAW_POST).alias("r")).select("r.*")
    posts = normalize(raw, provider, F.lit(datetime.now(timezone.utc)))
    place = _place(root, "posts", monday)
    posts.orderBy(fold(F.col("subreddit")), "created_at", "id").write.mode("overwrite").parquet(place)
    failed = {r.community: r.error for r in errors.collect()}  # a row for each community at most
    counts = {r.c: r.n for r in spark.read.parquet(place).groupBy(F.col("subreddit").alias("c")).agg(F.count("*").alias("n")).collect()}
    iso = lambda t: t.astimezone(timezone.utc).isoformat().replace("+00:00", "Z")
    record = {
        "schema_version": VERSION, "provider": provider, "status": "partial" if failed else "ok", "elapsed_seconds": round(time.perf_counter() - began, 3),
        "window": {"timezone": ZONE, "start_local": start.isoformat(), "end_local": end.isoformat(), "start_utc": iso(start_utc), "end_utc": iso(end_utc)},
        "community_count": len(communities), "community_counts": counts, "total_posts": sum(counts.values()), "errors": failed,
    }
    _record(spark, _place(root, "runs", monday), record)
    return record


def classify_week(
    spark: SparkSession, root: str, classifier: classify.Classifier, week: date | str, *, full: bool = False, max_posts: int | None = None, max_batches: int | None = None, status_only: bool = False,
    screening: ScreeningConfig = ScreeningConfig(), scoring: classify.ScoringConfig = classify.ScoringConfig(), notes: DataFrame | None = None, expected_survivors: int | None = None, checkpoint_batches: int = 8,
) -> dict:
    """Screen, classify what is pending within the bounds, score and append; a later call goes on from there.

    ``checkpoint_batches`` batches are called side by side and appended before
    the next are called, so a lost driver loses the answers of so many at most
    (1: a checkpoint after every batch). A failed batch ends the run once the
    answers of those beside it are kept.
    """
    check_run(full, max_posts, max_batches, status_only)
    if checkpoint_batches <= 0:
        raise ValueError("a checkpoint has at least one batch")
    monday = _monday(week)
    posts = spark.read.parquet(_place(root, "posts", monday))
    screened = screen(posts, screening)
    inputs = classify.build_inputs(screened, scoring, notes)
    total = expect_count(inputs.count(), expected_survivors)
    sources = {"posts": table_fingerprint(posts), "screening": repr(screening), "scoring": repr(scoring)}
    run = ResumableRun(spark, _place(root, "classified", monday), sources, total, scoring.batch_size)
    run.open(inputs)
    if not status_only:
        pending = run.pending(inputs)
        order = [fold(F.col("subreddit")), F.col("post_id")]
        numbered = cut(batches(pending, scoring.batch_size, order), "pending")
        limit, _ = run_limit(pending.count(), scoring.batch_size, max_posts, max_batches)
        if limit:
            names = posts.select(F.col("id").alias("post_id"), "subreddit", "title").dropDuplicates(["post_id"])
            step = scoring.batch_size * checkpoint_batches
            for first in range(0, limit, step):
                window = numbered.where((F.col("ord") >= first) & (F.col("ord") < min(limit, first + step)))
                answers, failures = classify.try_classify(window, classifier, config=scoring)
                run.append(classify.score_classified(answers, screened, scoring).join(names, "post_id"))
                classify.raise_failures(failures)
    return run.status(classify.USAGE)


def hydrate_week(spark: SparkSession, root: str, posts: DataFrame, week: date | str, expected: int | None = None) -> dict:
    """Shortlist the scored posts of a finished run and join freshly fetched ``posts`` to them."""
    monday = _monday(week)
    scored = spark.read.parquet(f"{_place(root, 'classified', monday)}/results")
    if scored.groupBy("post_id").count().where("count > 1").limit(1).count():
        raise ValueError("an id is scored twice")
    listed = shortlist.shortlist(scored)
    n = expect_count(listed.count(), expected)
    strange = [r.post_id for r in shortlist.unexpected_ids(listed, posts).limit(10).collect()]
    if strange:
        raise ValueError("posts that were not asked: " + ",".join(strange))
    shortlist.hydrate(listed, posts).write.mode("overwrite").parquet(_place(root, "hydrated", monday))
    lost = shortlist.missing_ids(listed, posts)
    missing = lost.count()
    record = {
        "schema_version": VERSION, "source_week": monday, "shortlist_rule": {"skip_must_be_false": True, "primary": {"preliminary_score_gte": shortlist.MIN_SCORE}, "rescue": {"relevance": shortlist.TOP_LABEL, "value": shortlist.TOP_LABEL, "preliminary_score_gte": shortlist.RESCUE_SCORE}},
        "stage_b_posts": scored.count(), "shortlist_count": n, "hydrated_count": n - missing, "missing_count": missing,
    }
    lost.write.mode("overwrite").parquet(_place(root, "missing", monday))
    _record(spark, _place(root, "hydration_runs", monday), record)
    return record


def dedup_week(spark: SparkSession, root: str, week: date | str, expected: int | None = None) -> dict:
    """Group the hydrated posts; raises unless every post is there and in one group."""
    monday = _monday(week)
    items = shortlist.check_hydrated(spark.read.parquet(_place(root, "hydrated", monday)), expected)
    place = _place(root, "groups", monday)
    dedup.dedup_groups(items).write.mode("overwrite").parquet(place)
    summary = dedup.summarize(spark.read.parquet(place)).first().asDict()
    if summary["input_posts"] != items.count():
        raise RuntimeError("the groups don't hold every post")
    _record(spark, _place(root, "dedup_runs", monday), {"schema_version": VERSION, "source_week": monday, "summary": summary})
    return summary
