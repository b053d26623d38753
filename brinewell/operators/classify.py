"""Classification of kept posts by a pluggable batch classifier: inputs, payloads, repair, validation and scores."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.functions.text import fold, strip
from brinewell.plans.lineage import cut, small

#: The kinds of posts, and the bounds of a call.
KINDS = ("news", "tool", "release", "discussion", "recommendation", "comparison", "experience", "showcase", "question", "research", "other")
MAX_BATCH, DEFAULT_TOKENS, TOKEN_RANGE, ATTEMPT_RANGE = 25, 3000, (16, 5000), (1, 2)
USAGE = ("input_tokens", "output_tokens", "cached_input_tokens", "reasoning_tokens")
_FIELDS = {"post_id": str, "relevance": int, "value": int, "kind": str, "skip": bool, "skip_reason": (str, type(None))}

#: A classifier takes a batch's JSON payload and the token bound, and returns ``(response, usage)`` as JSON-like objects.
Classifier = Callable[[str, int], tuple[dict, dict | None]]


@dataclass(frozen=True)
class ScoringConfig:
    batch_size: int = 25
    excerpt_chars: int = 300
    relevance: tuple[int, int] = (0, 3)
    value: tuple[int, int] = (0, 3)
    engagement_weight: float = 0.4
    label_weight: float = 0.6


def build_inputs(screened: DataFrame, config: ScoringConfig = ScoringConfig(), notes: DataFrame | None = None) -> DataFrame:
    """``(post_id, subreddit, title, body_excerpt, external_domain, subreddit_note)`` of the kept posts.

    ``notes`` has ``(community, note)``. A kept post without a score raises.
    """
    checked = F.when(F.col("engagement_score").isNull(), F.raise_error(F.concat(F.lit("no engagement score: "), F.col("id"))).cast("string")).otherwise(F.col("id"))
    out = screened.where("keep").select(
        checked.alias("post_id"), "subreddit", strip(F.col("title")).alias("title"), F.substring(strip(F.col("body")), 1, config.excerpt_chars).alias("body_excerpt"),
        F.when(~F.col("is_self"), F.col("domain")).alias("external_domain"), *(c for c in ("ord",) if c in screened.columns),
    )
    if notes is None:
        return out.withColumn("subreddit_note", F.lit(None).cast("string"))
    by_name = notes.select(fold(F.col("community")).alias("name__"), F.col("note").alias("subreddit_note")).dropDuplicates(["name__"])
    return out.join(small(by_name), fold(F.col("subreddit")) == F.col("name__"), "left").drop("name__")


def payloads(batched: DataFrame) -> DataFrame:
    """``(batch_id, post_ids, payload)``: compact JSON of each batch in order, null keys left out."""
    item = F.struct("ord", F.struct("post_id", "subreddit", "title", "body_excerpt", "external_domain", "subreddit_note").alias("item"))
    rows = batched.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("rows"))  # at most a batch's rows
    return rows.select("batch_id", F.col("rows.item.post_id").alias("post_ids"), F.to_json(F.struct(F.col("rows.item").alias("posts"))).alias("payload"))


def check_call(batch: int, max_tokens: int = DEFAULT_TOKENS, attempts: int = 2) -> None:
    if not 1 <= batch <= MAX_BATCH:
        raise ValueError(f"a batch has 1 to {MAX_BATCH} posts")
    if not TOKEN_RANGE[0] <= max_tokens <= TOKEN_RANGE[1]:
        raise ValueError(f"output tokens must be in {TOKEN_RANGE}")
    if not ATTEMPT_RANGE[0] <= attempts <= ATTEMPT_RANGE[1]:
        raise ValueError(f"attempts must be in {ATTEMPT_RANGE}")


def parse_response(response: dict, config: ScoringConfig = ScoringConfig()) -> list[dict]:
    """The classifications of a response; raises unless types, ranges, kinds and keys are exactly those expected."""
    if not isinstance(response, dict) or set(response) != {"classifications"} or not isinstance(response["classifications"], list):
        raise ValueError("a response holds a list of classifications and nothing else")
    for c in response["classifications"]:
        if not isinstance(c, dict) or set(c) - set(_FIELDS) or set(_FIELDS) - set(c) - {"skip_reason"}:
            raise ValueError("a classification has missing or unknown fields")
        for name, kind in _FIELDS.items():
            v = c.get(name)
            if not isinstance(v, kind) or isinstance(v, bool) != (kind is bool):
                raise ValueError(f"{name} has the wrong type")
        for name, (low, high) in (("relevance", config.relevance), ("value", config.value)):
            if not low <= c[name] <= high:
                raise ValueError(f"{name} is out of range")
        if c["kind"] not in KINDS:
            raise ValueError("the kind is unknown")
    return [{"skip_reason": None, **c} for c in response["classifications"]]


def repair_ids(rows: list[dict], expected: Sequence[str]) -> list[dict]:
    """Give a single misspelt id its right spelling, where only one reading is possible; else the rows as they are."""
    returned = [r["post_id"] for r in rows]
    if len(returned) != len(expected) or len(set(expected)) != len(expected):
        return rows
    lost, strange = set(expected).difference(returned), set(returned).difference(expected)
    if len(lost) != 1 or len(strange) != 1:
        return rows
    wrong, right = strange.pop(), lost.pop()
    if returned.count(wrong) > 1:
        return rows
    return [{**r, "post_id": right} if r["post_id"] == wrong else r for r in rows]


def check_batch(rows: list[dict], expected: Sequence[str]) -> None:
    """Raise unless the rows answer the expected ids once each, and give a reason just where they skip."""
    ids = [r["post_id"] for r in rows]
    if len(set(ids)) < len(ids):
        raise ValueError("an id is answered twice")
    if lost := sorted(set(expected) - set(ids)):
        raise ValueError("ids without an answer: " + ",".join(lost))
    if strange := sorted(set(ids) - set(expected)):
        raise ValueError("ids that were not asked: " + ",".join(strange))
    for r in rows:
        reason = r["skip_reason"]
        if r["skip"] and not (reason or "").strip():
            raise ValueError(f"{r['post_id']} is skipped without a reason")
        if not r["skip"] and reason is not None:
            raise ValueError(f"{r['post_id']} has a reason but is not skipped")


def usage_counts(usage: dict | None) -> list[int]:
    """Input, output, cached and reasoning tokens; what is missing counts 0."""
    usage = usage or {}
    return [int(usage.get("input_tokens") or 0), int(usage.get("output_tokens") or 0), int((usage.get("input_tokens_details") or {}).get("cached_tokens") or 0), int((usage.get("output_tokens_details") or {}).get("reasoning_tokens") or 0)]


def classify_batch(payload: str, ids: Sequence[str], classifier: Classifier, max_tokens: int = DEFAULT_TOKENS, attempts: int = 2, config: ScoringConfig = ScoringConfig()) -> tuple[list[dict], list[int], int]:
    """Rows, token counts of the attempt that passed, and the number of attempts."""
    check_call(len(ids), max_tokens, attempts)
    last: Exception | None = None
    for attempt in range(1, attempts + 1):
        try:
            response, usage = classifier(payload, max_tokens)
            if response is None:
                raise ValueError("the classifier gave no response")
            rows = repair_ids(parse_response(response, config), ids)
            check_batch(rows, ids)
            return rows, usage_counts(usage), attempt
        except Exception as e:  # a bad answer is tried again like a failed call
            last = e
    raise RuntimeError(f"no valid answer in {attempts} attempts") from last


_RESULT = "batch_id long, pos int, post_id string, relevance bigint, value bigint, kind string, skip boolean, skip_reason string, attempts int, " + ", ".join(f"{u} bigint" for u in USAGE) + ", error string"


def try_classify(batched: DataFrame, classifier: Classifier, max_tokens: int = DEFAULT_TOKENS, attempts: int = 2, config: ScoringConfig = ScoringConfig()) -> tuple[DataFrame, DataFrame]:
    """Answers, as of :func:`classify`, and failures ``(batch_id, error)``.

    A batch without a valid answer is a row of the second and costs no other
    batch its answer. The result is written once, so that an executor's loss
    repeats no call that was committed. Each batch is a partition's own, so
    calls run side by side.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for batch, ids, payload in zip(part["batch_id"], part["post_ids"], part["payload"], strict=True):
                try:
                    answers, tokens, tries = classify_batch(payload, list(ids), classifier, max_tokens, attempts, config)
                except RuntimeError as e:
                    rows.append((batch, None, None, None, None, None, None, None, attempts, 0, 0, 0, 0, f"{e}: {e.__cause__}"))
                    continue
                rows += [(batch, k, a["post_id"], a["relevance"], a["value"], a["kind"], a["skip"], a["skip_reason"], tries, *(tokens if k == 0 else [0] * 4), None) for k, a in enumerate(answers)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _RESULT.split(", ")]).astype({"pos": "Int32", "relevance": "Int64", "value": "Int64", "skip": "boolean"})

    told = cut(payloads(batched).repartition("batch_id").mapInPandas(run, _RESULT), "classified")
    return told.where("error is null").drop("error"), told.where("error is not null").select("batch_id", "error")


def raise_failures(failures: DataFrame) -> None:
    """Raise with the first failures, if there are any."""
    bad = failures.orderBy("batch_id").limit(5).collect()
    if bad:
        raise RuntimeError("; ".join(f"batch {r.batch_id}: {r.error}" for r in bad))


def classify(batched: DataFrame, classifier: Classifier, max_tokens: int = DEFAULT_TOKENS, attempts: int = 2, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """One row per post in response order (``batch_id``, ``pos``), with the batch's attempts and token counts on its first row; raises if a batch fails."""
    answers, failures = try_classify(batched, classifier, max_tokens, attempts, config)
    raise_failures(failures)
    return answers


def offline_classifier(payload: str, max_tokens: int) -> tuple[dict, dict | None]:
    """A deterministic stand-in that needs no network: labels from a checksum of each id."""
    import zlib

    rows = []
    for p in json.loads(payload)["posts"]:
        h = zlib.crc32(p["post_id"].encode())
        skip = h % 19 == 0
        rows.append({"post_id": p["post_id"], "relevance": h % 4, "value": h // 4 % 4, "kind": KINDS[h % len(KINDS)], "skip": skip, "skip_reason": "off topic" if skip else None})
    return {"classifications": rows}, {"input_tokens": len(payload) // 4, "output_tokens": 30 * len(rows)}


def preliminary_score(engagement: Column, relevance: Column, value: Column, config: ScoringConfig = ScoringConfig()) -> Column:
    """Weighted mean of engagement and the mean label; raises for arguments out of range."""
    ok = engagement.between(0.0, 1.0) & relevance.between(*config.relevance) & value.between(*config.value)
    labels = (relevance + value) / F.lit(6.0)
    score = (engagement * config.engagement_weight + labels * config.label_weight) / (config.engagement_weight + config.label_weight)
    return F.when(F.coalesce(ok, F.lit(False)), score).otherwise(F.raise_error(F.lit("engagement or label out of range")).cast("double"))


def score_classified(classified: DataFrame, screened: DataFrame, config: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Classified posts with engagement and preliminary score; an id without exactly one kept post raises."""
    kept = screened.where("keep").groupBy(F.col("id").alias("post_id")).agg(F.max("engagement_score").alias("engagement_score"), F.count("*").alias("n__"))
    both = classified.join(kept, "post_id", "left")
    checked = F.when(F.coalesce("n__", F.lit(0)) == 1, F.col("engagement_score")).otherwise(F.raise_error(F.concat(F.lit("not one kept post: "), F.col("post_id"))).cast("double"))
    both = both.withColumn("engagement_score", checked).drop("n__")
    return both.withColumn("preliminary_score", preliminary_score(F.col("engagement_score"), F.col("relevance"), F.col("value"), config))


def violations(classified: DataFrame, expected: DataFrame) -> DataFrame:
    """``(post_id, problem)`` of a classification table against the expected ids; empty if it is valid."""
    counts = classified.groupBy("post_id").agg(F.count("*").alias("n"))
    out = counts.where("n > 1").select("post_id", F.lit("duplicate").alias("problem"))
    out = out.union(expected.select("post_id").join(counts, "post_id", "left_anti").select("post_id", F.lit("missing")))
    out = out.union(counts.join(expected.select("post_id").distinct(), "post_id", "left_anti").select("post_id", F.lit("unexpected")))
    blank = F.coalesce(strip(F.col("skip_reason")), F.lit("")) == ""
    out = out.union(classified.where(F.col("skip") & blank).select("post_id", F.lit("no_reason")))
    return out.union(classified.where(~F.col("skip") & F.col("skip_reason").isNotNull()).select("post_id", F.lit("needless_reason")))


def usage_totals(classified: DataFrame) -> DataFrame:
    """Posts, batches and token counts of a run, in one row."""
    return classified.agg(F.count("*").alias("posts"), F.countDistinct("batch_id").alias("batches"), *(F.coalesce(F.sum(u), F.lit(0)).alias(u) for u in USAGE), F.count_if("skip").alias("skipped"))
