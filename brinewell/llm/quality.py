"""Quality rules with risk-controlled thresholds.

Each rule is a statistic of a document, high where the text is poor, and a grid
of cutoffs from lenient to strict that is fixed beforehand. Documents that are
labelled good are the holdout: in a stratum (a language), a cutoff is certified
when the exact binomial (Clopper-Pearson) upper bound of its false rejection
rate is at most ``alpha`` / number of rules. Cutoffs are tested in fixed
sequence from the lenient end, which needs no correction within a rule; across
rules and strata the error ``delta`` is split evenly (Bonferroni). With
probability 1 - delta, then, no stratum loses more than ``alpha`` of its good
documents to all rules together. Of the certified cutoffs the one that rejects
most poor documents, each wrongly rejected good one weighing PRICE, is used;
with too few labels none is certified and the rule rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from brinewell.plans.lineage import cut, small

#: Rules, and their cutoffs from lenient to strict. A document is rejected when 1000 * top > cutoff * bottom.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "upper_case": ("n_upper", "n_letters"),
    "long_words": ("word_chars", "n_words"),
}
CUTOFFS = {
    "symbols": (500, 400, 300, 250, 200, 150, 100, 70, 50),
    "duplicate_lines": (900, 800, 700, 600, 500, 400, 300),
    "repeated_words": (500, 450, 400, 350, 300, 250, 200),
    "upper_case": (950, 900, 800, 700, 600, 500, 400, 300),
    "long_words": (30000, 20000, 15000, 12000, 10000, 9000),
}
ALPHA, DELTA, PRICE = 0.02, 0.05, 10

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")
STATS = "id long, stratum string, " + ", ".join(f"{x} long" for x in _STATS)
_SCHEMA = pa.schema([("id", pa.int64()), ("stratum", pa.string()), *((x, pa.int64()) for x in _STATS)])
#: Latin capitals, for the share of upper case.
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    k = len(seen)
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # too many words for one number
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + n] |= twice
    return int(inside.sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of the statistics' columns."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    letters = sum(text.count(x) + text.count(x.lower()) for x in _UPPER) if words else 0
    upper = sum(map(text.count, _UPPER)) if words else 0
    return (len(words), len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), _repeated(words), letters, upper)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            rows = [text_stats(x.as_py()) for x in batch.column(2)]
            cols = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], schema=_SCHEMA)


def rejects(rule: str, cutoff: Column) -> Column:
    top, bottom = RULES[rule]
    return F.col(top) * 1000 > cutoff * F.col(bottom)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial; the exact bound holds at alpha when this is at most the error.

    It is the regularised incomplete beta function of n - k and k + 1 at 1 - p,
    here by its continued fraction (Lentz), so no step is as long as the counts.
    """
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, p)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function where its continued fraction converges fast, x at most (a + 1) / (a + b + 2)."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * out)


def certified_cutoffs(counts: DataFrame, alpha: float = ALPHA, delta: float = DELTA, price: int = PRICE) -> DataFrame:
    """``(stratum, rule, cutoff)`` from rows ``(stratum, rule, step, cutoff, good, good_rejected, bad_rejected)``.

    The bound is tested in closed form: the upper bound is at most a if and
    only if P(X <= rejected | good, a) is at most the error.
    """
    strata = max(1, counts.select("stratum").distinct().count())
    error, rate = delta / (strata * len(RULES)), alpha / len(RULES)

    def passes(good, rejected):
        return [binomial_cdf(int(k), int(n), rate) <= error for n, k in zip(good, rejected, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array(passes(b.column("good").to_pylist(), b.column("good_rejected").to_pylist()), pa.bool_())
            yield b.append_column("ok", ok)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)
    tested = counts.mapInArrow(run, fields + ", ok boolean")
    upto = W.partitionBy("stratum", "rule").orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    sound = tested.withColumn("ok", F.min("ok").over(upto)).where("ok")
    gain = F.col("bad_rejected") - F.col("good_rejected") * price
    best = sound.where(gain > 0).groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain, -F.col("step"))).alias("cutoff"))
    return best


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", label_col: str = "quality") -> DataFrame:
    """``(id, n_words, ..., base_failed, failed_rules, kept)``, one row per row of ``docs``.

    ``base_failed``: fewer than 50 words, or more than half of the words in
    repeated 3-word windows. ``failed_rules``: rules whose certified cutoff for
    the document's stratum it exceeds. ``kept``: neither.

    A label counts if all labels of its id agree (1 good, 0 poor); documents
    that fail the base are no part of the holdout. Null texts have no words;
    null strata are one stratum; strata without certified cutoffs keep what
    passes the base. Repeated rows each give their row; empty tables give no
    rows, or no cutoffs. Other columns, of whatever name, are not read.
    """
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    source = docs.select(F.col(id_col).cast("long").alias("id"), stratum.alias("stratum"), F.col(text_col).cast("string").alias("text"))
    stats = source.mapInArrow(_stats, STATS)
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    stats = cut(stats.withColumn("base_failed", base), "stats")

    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("mark")).where("mark in (0, 1)")
    marks = marks.groupBy("id").agg(F.min("mark").alias("mark"), F.max("mark").alias("top")).where("mark = top").drop("top")
    held = stats.where(~F.col("base_failed")).join(marks, "id")
    tests = [(rule, k, c) for rule, cs in CUTOFFS.items() for k, c in enumerate(cs)]
    sums = [F.count_if((F.col("mark") == mark) & rejects(rule, F.lit(c))).alias(f"{rule}:{k}:{mark}") for rule, k, c in tests for mark in (0, 1)]
    wide = cut(held.groupBy("stratum").agg(F.count_if(F.col("mark") == 1).alias("good"), *sums), "holdout")
    rows = F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(k).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{rule}:{k}:1").alias("good_rejected"), F.col(f"{rule}:{k}:0").alias("bad_rejected")) for rule, k, c in tests))
    best = certified_cutoffs(wide.select("stratum", "good", F.inline(rows)))
    cutoffs = cut(best.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in RULES)), "cutoffs")

    failed = F.array_compact(F.array(*(F.when(rejects(r, F.col(f"cutoff_{r}")), F.lit(r)) for r in RULES)))
    judged = stats.join(small(cutoffs), "stratum", "left").withColumn("failed_rules", failed)
    return judged.select("id", *_STATS, "stratum", "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
