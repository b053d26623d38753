import random

import pytest
from pyspark.sql import functions as F

from brinewell.operators import ranking
from brinewell.operators.screening import ScreeningConfig, label, screen

POST = "ord long, id string, subreddit string, title string, body string, score long, comment_count long, is_locked boolean, is_crosspost boolean, is_stickied boolean, removed_state string"


def post(k, i, title="t", body="b", score=9, comments=9, locked=False, cross=False, sticky=False, removed="none", sub="A"):
    return (k, i, sub, title, body, score, comments, locked, cross, sticky, removed)


def test_golden_labels(spark):
    rows = [
        post(0, "1w9aqfz", score=29, comments=9),
        post(1, "1w9r2rj", score=1, comments=1, removed="removed"),
        post(2, "1w9bvj4", score=0, comments=0),
        post(3, "1w9w5nn", "Weekly Hiring Thread", score=4, comments=3, sticky=True),
        post(4, "1wapn2b", score=1, comments=3, locked=True),
        post(5, "1wclo7d", score=1, comments=6, cross=True),
        post(6, "both", score=1, comments=6, cross=True, locked=True),
        post(7, "first", "Giveaway: buy upvotes", removed="deleted"),
        post(8, "second", "Giveaway: buy upvotes"),
        post(9, "third", "buy upvotes", score=0, comments=0),
        post(10, "spam", body="message me\non x, whatsapp"),
        post(11, "near", body="message me on whatsapp"),
        post(12, "stick", "Jobs thread", sticky=True),
        post(13, "loose", "Jobs thread"),
    ]
    got = {r.id: (r.keep, r.reason) for r in label(spark.createDataFrame(rows, POST)).collect()}
    assert got == {
        "1w9aqfz": (True, "normal"), "1w9r2rj": (False, "removed"), "1w9bvj4": (False, "low_engagement"), "1w9w5nn": (False, "routine_sticky"), "1wapn2b": (True, "locked_allowed"),
        "1wclo7d": (True, "crosspost_allowed"), "both": (True, "locked_allowed"), "first": (False, "deleted"), "second": (False, "giveaway"), "third": (False, "obvious_spam"),
        "spam": (True, "normal"), "near": (False, "obvious_spam"), "stick": (False, "routine_sticky"), "loose": (True, "normal"),
    }
    free = ScreeningConfig(frozenset(), False, False, False)
    assert {r.reason for r in label(spark.createDataFrame(rows, POST), free).collect()} == {"normal", "low_engagement", "locked_allowed", "crosspost_allowed"}


def test_engagement_is_ranked_among_kept_posts_of_a_community(spark):
    rows = [post(0, "a", score=10, comments=10, sub="X"), post(1, "b", score=20, comments=30, sub="x"), post(2, "c", score=30, comments=20, sub="X"), post(3, "gone", "giveaway", score=99, comments=99, sub="X"), post(4, "alone", sub="Y")]
    got = {r.id: (r.score_rank, r.comment_count_rank, r.engagement_score) for r in screen(spark.createDataFrame(rows, POST)).collect()}
    assert got == {"a": (0.0, 0.0, 0.0), "b": (0.5, 1.0, 0.75), "c": (1.0, 0.5, 0.75), "gone": (None, None, None), "alone": (1.0, 1.0, 1.0)}


def brute_midrank(values):
    s = sorted(values)
    if len(s) == 1:
        return [1.0]
    return [sum(k for k, x in enumerate(s) if x == v) / s.count(v) / (len(s) - 1) for v in values]


@pytest.mark.parametrize("values", [[5, 5, 1, 9, 9, 9], [4], [7, 7], [], [random.Random(2).randrange(6) for _ in range(60)]])
def test_midrank(spark, values):
    df = spark.createDataFrame([(k, "g", v) for k, v in enumerate(values)], "k int, g string, v int")
    got = [r.rank for r in ranking.midrank(df, ["g"], "v", "rank").orderBy("k").collect()]
    assert got == pytest.approx(brute_midrank(values) if values else [])


def test_spread_sample_and_batches(spark):
    df = spark.range(53).select(F.col("id").alias("x"))
    for count in (1, 2, 7, 53, 60):
        got = sorted(r.x for r in ranking.spread_sample(df, count, [F.col("x")]).collect())
        assert got == (list(range(53)) if count >= 53 else [26] if count == 1 else [round(p * 52 / (count - 1)) for p in range(count)])
    with pytest.raises(ValueError):
        ranking.spread_sample(df, 0, [F.col("x")])
    sizes = sorted(r["count"] for r in ranking.batches(df, 25, [F.col("x")]).groupBy("batch_id").count().collect())
    assert sizes == [3, 25, 25]
    with pytest.raises(ValueError):
        ranking.batches(df, 0, [F.col("x")])
    assert ranking.run_limit(53, 25, 40, 1) == (25, True) and ranking.run_limit(10, 25) == (10, False)


def test_row_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(v,) for v in random.Random(4).sample(range(1000), 300)], "v int")
    got = ranking.with_row_number(df, [F.col("v")]).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(300)) and [r.v for r in got] == sorted(r.v for r in got)


def test_upsert(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "ord int, k string, v int")
    assert sorted(map(tuple, ranking.upsert(df, "k", "ord").collect())) == [("a", 0, 3), ("b", 1, 2)]
