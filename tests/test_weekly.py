import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from brinewell.operators import classify
from brinewell.plans import weekly

cloudpickle.register_pickle_by_value(sys.modules[__name__])
MONDAY = "2026-09-07"
START = 1788732000  # 2026-09-06T22:00:00Z


def transport(path, params):
    if params["subreddit"] == "Broken":
        raise OSError("down")
    rows = [{"id": f"{params['subreddit']}{k}", "subreddit": params["subreddit"], "title": f"post {k}", "score": 5 + k, "num_comments": 3, "created_utc": START + 60 * k, "url": f"https://x.org/{k // 2}", "domain": "x.org"} for k in range(-3, 40)]
    return {"data": [r for r in rows if params["after"] <= r["created_utc"] < params["before"]][: params["limit"]]}


def fails_at(post, log):
    """A classifier that is down for one post's batch and writes down the posts that it answers."""

    def classifier(payload, tokens):
        if f'"{post}"' in payload:
            raise OSError("down")
        answer = classify.offline_classifier(payload, tokens)
        with open(log, "a") as f:
            f.write("".join(r["post_id"] + "\n" for r in answer[0]["classifications"]))
        return answer

    return classifier


def test_a_week_from_fetch_to_groups(spark, tmp_path):
    root = str(tmp_path)
    record = weekly.fetch_week(spark, root, transport, ["Beta", "Alpha", "Broken"], MONDAY)
    assert record["status"] == "partial" and record["community_counts"] == {"Alpha": 40, "Beta": 40} and list(record["errors"]) == ["Broken"]
    assert record["window"]["start_utc"] == "2026-09-06T22:00:00Z"
    with pytest.raises(ValueError):
        weekly.classify_week(spark, root, classify.offline_classifier, MONDAY)
    with pytest.raises(ValueError):
        weekly.classify_week(spark, root, classify.offline_classifier, MONDAY, full=True, expected_survivors=81)
    assert weekly.classify_week(spark, root, classify.offline_classifier, MONDAY, max_batches=1).items() >= {"posts_completed": 25, "total": 80, "complete": False, "batches_completed": 1}.items()
    assert weekly.classify_week(spark, root, classify.offline_classifier, MONDAY, max_posts=10)["posts_completed"] == 35
    assert weekly.classify_week(spark, root, classify.offline_classifier, MONDAY, status_only=True)["posts_completed"] == 35
    with pytest.raises(RuntimeError, match="batch 1"):
        weekly.classify_week(spark, root, fails_at("Beta9", f"{root}/calls"), MONDAY, full=True, checkpoint_batches=1)
    kept = weekly.classify_week(spark, root, classify.offline_classifier, MONDAY, status_only=True)
    assert kept["posts_completed"] == 60 and kept["batches_completed"] == 3 and kept["usage"]["output_tokens"] == 60 * 30
    assert weekly.classify_week(spark, root, fails_at("nothing", f"{root}/calls"), MONDAY, full=True)["complete"]
    asked = open(f"{root}/calls").read().split()
    assert len(asked) == len(set(asked)) == 45  # no post that was answered is asked again
    assert weekly.classify_week(spark, root, classify.offline_classifier, MONDAY, full=True)["complete"]
    scored = spark.read.parquet(f"{root}/classified/week_start={MONDAY}/results")
    assert scored.count() == scored.select("post_id").distinct().count() == 80
    posts = spark.read.parquet(f"{root}/posts")
    assert posts.where(F.col("week_start") == MONDAY).count() == 80
    listed = {r.post_id for r in weekly.shortlist.shortlist(scored).collect()}
    fresh = posts.drop("week_start").where(F.col("id").isin(*listed))
    got = weekly.hydrate_week(spark, root, fresh, MONDAY)
    assert got["shortlist_count"] == got["hydrated_count"] == len(listed) > 2 and got["missing_count"] == 0
    with pytest.raises(ValueError):
        weekly.hydrate_week(spark, root, posts.drop("week_start"), MONDAY)
    summary = weekly.dedup_week(spark, root, MONDAY)
    groups = spark.read.parquet(f"{root}/groups/week_start={MONDAY}").collect()
    assert summary["input_posts"] == len(listed) == sum(len(g.members) for g in groups)
    assert all(g.representative.post.id == g.representative_post_id == g.members[0].stage_b.post_id for g in groups)
    assert weekly.hydrate_week(spark, root, fresh.where(F.col("id") != min(listed)), MONDAY)["missing_count"] == 1
    with pytest.raises(ValueError):
        weekly.dedup_week(spark, root, MONDAY)
