import io
import json
import sys
import urllib.error
from datetime import datetime, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from brinewell.plans.resume import ResumableRun, check_run, expect_count, table_fingerprint
from brinewell.sources import files, http
from brinewell.sources.memory import TableSource, WebSource
from brinewell.streaming.ingest import label_stream, stream_posts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


class FakeApi:
    """Pages of posts by second; three posts share a second at a page's end."""

    def __init__(self, rows, page=100):
        self.rows, self.page = rows, page

    def __call__(self, path, params):
        if path.endswith("ids"):
            return {"data": [r for r in self.rows if r["id"] in params["ids"].split(",")]}
        if params["subreddit"] == "broken":
            raise OSError("down")
        own = sorted((r for r in self.rows if params["after"] <= r["created_utc"] < params["before"]), key=lambda r: r["created_utc"])
        return {"data": own[: params["limit"]]}


def api():
    return FakeApi([{"id": f"p{k}", "created_utc": 1000 + k // 3, "subreddit": "X", "title": "t", "score": k} for k in range(300)])


def at(s):
    return datetime.fromtimestamp(s, tz=timezone.utc)


def test_window_scan_pages_without_loss():
    rows = list(http.window_rows(api(), "X", 1000, 1090))
    assert len(rows) == 270 and len({r["id"] for r in rows}) == 270
    assert [r["created_utc"] for r in rows] == sorted(r["created_utc"] for r in rows)
    with pytest.raises(ValueError):
        list(http.window_rows(api(), "X", 5, 5))


def test_data_source_isolates_errors(spark):
    rows, errors = http.scan_window(spark, api(), ["X", "broken"], at(1000), at(1010))
    assert rows.count() == 30 and [(r.community, "down" in r.error) for r in errors.collect()] == [("broken", True)]
    assert http.run_status(errors) == "partial"
    with pytest.raises(ValueError):
        http.scan_window(spark, api(), ["X"], datetime(2026, 1, 1), at(1))


def test_web_source(spark):
    web = WebSource(spark, api())
    got = web.posts("X", at(1000), at(1002)).collect()
    assert [r.id for r in got][:3] == ["p0", "p1", "p2"] and len(got) == 6 and got[0].permalink == "https://www.reddit.com/r/X/comments/p0/"
    assert [r.id for r in web.posts_by_ids(["t3_p5", "nope", "p1", "p5"]).collect()] == ["p5", "p1", "p5"]
    with pytest.raises(RuntimeError):
        web.posts("broken", at(1), at(2))
    with pytest.raises(NotImplementedError):
        web.comments("x")


def test_table_source(spark):
    posts = spark.createDataFrame([("a", "X", at(5), 0), ("b", "x", at(9), 1), ("a", "X", at(6), 2)], "id string, subreddit string, created_at timestamp, ord int")
    comments = spark.createDataFrame([("c", "a"), ("d", "b")], "id string, post_id string")
    src = TableSource(posts, comments)
    assert src.posts("X", at(5), at(9)).count() == 2
    assert [(r.id, r.created_at.timestamp()) for r in src.posts_by_ids(["b", "a", "zz", "a"]).collect()] == [("b", 9), ("a", 6), ("a", 6)]
    assert [r.id for r in src.comments("a").collect()] == ["c"]


def test_retries():
    waits, answers = [], [urllib.error.HTTPError("u", 429, "slow", {"X-RateLimit-Reset": "500"}, None), urllib.error.HTTPError("u", 503, "x", {}, None), urllib.error.URLError("net"), io.BytesIO(b'{"data": []}')]

    def opener(url, timeout):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert http.UrlTransport("http://h", sleep=waits.append, opener=opener)("/p", {"a": 1}) == {"data": []}
    assert waits == [60, 2, 4.0]
    answers[:] = [urllib.error.HTTPError("u", 404, "no", {}, None)]
    with pytest.raises(urllib.error.HTTPError):
        http.UrlTransport("http://h", sleep=waits.append, opener=opener)("/p", {})


def test_files(spark, tmp_path):
    files.write_json_document({"posts": [{"id": "a", "title": "é", "score": 3, "created_at": "2026-01-02T03:04:05Z", "fetched_at": "2026-01-02T03:04:05.5Z"}]}, tmp_path / "posts.json")
    assert (tmp_path / "posts.json").read_text(encoding="utf-8").endswith("}\n") and "é" in (tmp_path / "posts.json").read_text(encoding="utf-8")
    row = files.read_posts_json(spark, str(tmp_path / "posts.json")).first()
    assert (row.id, row.title, row.score, row.body) == ("a", "é", 3, None) and row.created_at.year == 2026
    got = files.file_hashes(spark, str(tmp_path / "posts.json")).first().sha256
    assert got == files.file_hash(tmp_path / "posts.json")
    files.write_json(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_configuration(tmp_path):
    pytest.importorskip("yaml")
    own = {
        "stage_a": {"hard_exclude": {"removed_states": ["removed"], "obvious_spam": True, "giveaways": False, "routine_stickies_or_megathreads": True}, "engagement": {"signals": {"score_weight": 1, "comment_count_weight": 3}, "absolute_floor": {"min_score": 2, "min_comment_count": 5}}},
        "stage_b": {"classifier": {"batch_size": 5, "body_excerpt_chars": 30, "relevance": {"min": 0, "max": 3}, "value": {"min": 0, "max": 3}, "kinds": list(files.KINDS)}, "preliminary_score": {"engagement_weight": 0.4, "llm_weight": 0.6}},
        "profile": {"communities": [{"name": "A", "note": " hi "}, {"name": "B"}]},
    }
    path = tmp_path / "c.yaml"
    path.write_text("﻿" + json.dumps(own), encoding="utf-8")
    a, b = files.load_screening_config(path), files.load_scoring_config(path)
    assert (a.exclude_giveaways, a.comment_weight, a.min_comments, b.batch_size) == (False, 3.0, 5, 5)
    assert files.load_communities(path, 2) == ["A", "B"] and files.load_notes(path) == {"a": "hi"}
    with pytest.raises(ValueError):
        files.load_communities(path, 24)
    own["stage_b"]["classifier"]["kinds"] = ["news"]
    path.write_text(json.dumps(own))
    with pytest.raises(ValueError):
        files.load_scoring_config(path)


def test_resumable_run(spark, tmp_path):
    ids = spark.createDataFrame([(f"p{k}",) for k in range(5)], "post_id string")
    run = ResumableRun(spark, str(tmp_path / "run"), {"in": "1"}, 5, 2)
    run.open(ids)
    run.step(ids.limit(2), lambda d: d.withColumn("x", F.lit(1)))
    assert run.status() == {"posts_completed": 2, "total": 5, "complete": False} and run.pending(ids).count() == 3
    again = ResumableRun(spark, str(tmp_path / "run"), {"in": "1"}, 5, 2)
    again.open(ids)
    again.step(ids, lambda d: d.withColumn("x", F.lit(1)))
    assert again.status()["complete"]
    with pytest.raises(ValueError):
        ResumableRun(spark, str(tmp_path / "run"), {"in": "2"}, 5, 2).open(ids)
    with pytest.raises(ValueError):
        again.open(ids.where("post_id <> 'p0'"))
    for bad in ((True, 1, None), (False, None, None), (False, 0, None)):
        with pytest.raises(ValueError):
            check_run(*bad)
    check_run(False, None, None, True)
    assert expect_count(3, None) == 3
    with pytest.raises(ValueError):
        expect_count(3, 4)
    assert table_fingerprint(ids) == table_fingerprint(ids.orderBy(F.desc("post_id")))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": "t3_a", "title": "giveaway", "score": "9", "created_utc": "1000"}, {"id": "b", "title": "t", "score": "9", "created_utc": "1001"}, {"id": "b", "title": "t", "score": "9", "created_utc": "1001"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, rows)))
    label_stream(stream_posts(spark, str(tmp_path / "in"), "s"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.reason for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": "giveaway", "b": "normal"}
