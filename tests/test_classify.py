
import pytest
from pyspark.sql import functions as F

from brinewell.operators import classify as C
from brinewell.operators import shortlist as S


def answer(i="a", **more):
    return {"post_id": i, "relevance": 1, "value": 2, "kind": "tool", "skip": False, "skip_reason": None} | more


def screened(spark, n):
    rows = [(k, f"p{k:02}", "OpenAI", f" t{k} ", "x" * 500, k % 2 == 0, "example.com", True, 0.5) for k in range(n)]
    rows += [(n, "gone", "OpenAI", "t", "b", False, None, False, None)]
    return spark.createDataFrame(rows, "ord long, id string, subreddit string, title string, body string, is_self boolean, domain string, keep boolean, engagement_score double")


def test_inputs_and_payloads(spark):
    notes = spark.createDataFrame([("openai", "n")], "community string, note string")
    got = {r.post_id: r for r in C.build_inputs(screened(spark, 2), notes=notes).collect()}
    assert set(got) == {"p00", "p01"} and len(got["p00"].body_excerpt) == 300 and got["p00"].title == "t0"
    assert got["p00"].external_domain is None and got["p01"].external_domain == "example.com" and got["p01"].subreddit_note == "n"
    batched = C.build_inputs(screened(spark, 2)).withColumn("batch_id", F.lit(0).cast("long"))
    row = C.payloads(batched).first()
    assert list(row.post_ids) == ["p00", "p01"]
    assert row.payload.startswith('{"posts":[{"post_id":"p00","subreddit":"OpenAI","title":"t0"') and "subreddit_note" not in row.payload
    bad = screened(spark, 1).withColumn("engagement_score", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no engagement score"):
        C.build_inputs(bad).collect()


@pytest.mark.parametrize("change", [{"relevance": 4}, {"value": -1}, {"kind": "poem"}, {"extra": 1}, {"relevance": True}, {"relevance": 1.0}, {"skip": 0}, {"post_id": None}, {"skip_reason": 3}])
def test_bad_fields_are_rejected(change):
    with pytest.raises(ValueError):
        C.parse_response({"classifications": [answer(**change)]})


def test_batch_rules():
    C.check_batch([answer("a"), answer("b", skip=True, skip_reason="r")], ["b", "a"])
    for rows, ids in (([answer("a")], ["a", "b"]), ([answer("a"), answer("a")], ["a"]), ([answer("a", skip=True)], ["a"]), ([answer("a", skip=True, skip_reason=" ")], ["a"]), ([answer("a", skip_reason="r")], ["a"]), ([answer("z")], ["a"])):
        with pytest.raises(ValueError):
            C.check_batch(rows, ids)


@pytest.mark.parametrize("returned, expected, want", [("ax", "ab", "ab"), ("xy", "ab", "xy"), ("axx", "abc", "axx"), ("abx", "ab", "abx"), ("aab", "abc", "aab")])
def test_repair(returned, expected, want):
    got = C.repair_ids([answer(i) for i in returned], list(expected))
    assert "".join(r["post_id"] for r in got) == want


def test_calls():
    calls = []

    def flaky(payload, tokens):
        calls.append(tokens)
        if len(calls) == 1:
            raise OSError("down")
        return {"classifications": [answer("a")]}, {"input_tokens": 5, "output_tokens_details": {"reasoning_tokens": 2}}

    rows, usage, tries = C.classify_batch("{}", ["a"], flaky)
    assert rows[0]["post_id"] == "a" and usage == [5, 0, 0, 2] and tries == 2
    with pytest.raises(RuntimeError):
        C.classify_batch("{}", ["a"], lambda p, t: (None, None))
    for n, tokens, tries in ((0, 3000, 2), (26, 3000, 2), (1, 5001, 2), (1, 15, 2), (1, 3000, 3), (1, 3000, 0)):
        with pytest.raises(ValueError):
            C.check_call(n, tokens, tries)


def test_offline_run_scores_every_post(spark):
    own = screened(spark, 53)
    batched = C.build_inputs(own).withColumn("batch_id", F.floor(F.col("ord") / 25).cast("long"))
    scored = C.score_classified(C.classify(batched, C.offline_classifier), own)
    assert scored.count() == 53
    total = C.usage_totals(scored).first()
    assert (total.posts, total.batches) == (53, 3) and total.output_tokens == 53 * 30
    assert C.violations(scored.select("post_id", "skip", "skip_reason"), C.build_inputs(own)).isEmpty()


def test_scores_and_shortlist(spark):
    rows = [("a", 0.5, 3, 3, False), ("b", 1.0, 1, 2, False), ("c", 0.4, 3, 3, False), ("d", 0.9, 3, 2, False), ("e", 0.5, 3, 3, True)]
    df = spark.createDataFrame(rows, "post_id string, e double, relevance int, value int, skip boolean").withColumn("subreddit", F.lit("x"))
    df = df.withColumn("preliminary_score", C.preliminary_score(F.col("e"), F.col("relevance"), F.col("value")))
    got = {r.post_id: r.preliminary_score for r in df.collect()}
    assert got["a"] == 0.8 and got["b"] == 0.7
    assert [r.post_id for r in S.shortlist(df).collect()] == ["d", "a", "c"]
    with pytest.raises(Exception, match="out of range"):
        df.select(C.preliminary_score(F.lit(1.5), F.lit(1), F.lit(1))).collect()


def test_hydration(spark):
    listed = spark.createDataFrame([("a",), ("b",)], "post_id string")
    posts = spark.createDataFrame([("b", 1), ("z", 2)], "id string, score int")
    assert {r.stage_b.post_id: r.post and r.post.score for r in S.hydrate(listed, posts).collect()} == {"a": None, "b": 1}
    assert [r[0] for r in S.missing_ids(listed, posts).collect()] == ["a"] and [r[0] for r in S.unexpected_ids(listed, posts).collect()] == ["z"]
    with pytest.raises(ValueError):
        S.check_hydrated(S.hydrate(listed, posts))
