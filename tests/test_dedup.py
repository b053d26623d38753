import hashlib
import random

import pytest

from brinewell.operators import dedup as D
from brinewell.operators.components import connected_components

ITEM = "stage_b struct<post_id string, subreddit string, preliminary_score double, relevance int, value int, engagement_score double>, post struct<id string, external_url string, crosspost_parent string>"


def item(i, url=None, parent=None, score=0.5):
    return ((i, "S", score, 1, 1, 0.5), (i, url, parent))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("shape", ["chain", "random", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 120
    pairs = {"chain": [(k, k + 1) for k in range(n - 1)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(70)], "star": [(0, k) for k in range(1, n)], "empty": []}[shape]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = union(n, pairs)
    assert got == {x: want[x] for p in pairs for x in p}


def test_groups(spark):
    items = [
        item("a", "http://x.org/1", score=0.9), item("b", "https://www.x.org/1/", "t3_p"), item("c", None, "p"), item("d", None, "q"), item("e", None, " t3_d "), item("f", parent="f"), item("g"), item("g", score=0.7),
    ]
    groups = {r.representative_post_id: r for r in D.dedup_groups(spark.createDataFrame(items, ITEM)).collect()}
    assert {k: sorted(g.member_post_ids) for k, g in groups.items()} == {"a": ["a", "b", "c"], "d": ["d", "e"], "f": ["f"], "g": ["g", "g"]}
    a = groups["a"]
    assert a.group_id == "dedup-" + hashlib.sha256(b"a\nb\nc").hexdigest()[:12]
    assert a.duplicate_signals == ["same_external_url", "shared_crosspost_parent"]
    assert [(u.normalized_url, list(u.post_ids)) for u in a.shared_external_urls] == [("x.org/1", ["a", "b"])]
    assert [tuple(x) for x in a.crosspost_links] == [("p", "b"), ("p", "c")]
    assert groups["d"].duplicate_signals == ["crosspost_parent_in_group"]
    assert groups["f"].duplicate_signals == ["crosspost_parent_in_group"] and not groups["f"].is_duplicate_group
    assert groups["g"].duplicate_signals == ["same_post_id"] and groups["g"].representative_score == 0.7
    s = D.summarize(D.dedup_groups(spark.createDataFrame(items, ITEM))).first().asDict()
    assert s == {"input_posts": 8, "groups": 4, "standalone_groups": 1, "duplicate_groups": 3, "posts_merged_as_duplicates": 4, "largest_group_size": 3}
    assert [r.size for r in D.top_groups(D.dedup_groups(spark.createDataFrame(items, ITEM)), 2).collect()] == [3, 2]


def test_no_items(spark):
    s = D.summarize(D.dedup_groups(spark.createDataFrame([], ITEM))).first().asDict()
    assert set(s.values()) == {0}


@pytest.mark.parametrize("bad", [(None, ("a", None, None)), (("a", "S", 1.0, 1, 1, 1.0), None), (("a", "S", 1.0, 1, 1, 1.0), ("b", None, None)), ((" a", "S", 1.0, 1, 1, 1.0), (" a", None, None))])
def test_bad_items_raise(spark, bad):
    with pytest.raises(Exception, match="bad item"):
        D.check_items(spark.createDataFrame([bad], ITEM)).collect()


def test_join_heavy(spark):
    from brinewell.plans.skew import join_heavy

    rows = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(5000)] + [(None, -1), (77777, -2)], "k long, v long")
    side = spark.createDataFrame([(k, k * 2, 1 if k != 1 else 3333) for k in range(5000)], "k long, twice long, n long")
    got = join_heavy(rows, side, ["k"], "n").collect()
    assert sorted(r.v for r in got) == sorted(r.v for r in rows.collect())
    assert all(r.twice == (None if r.k in (None, 77777) else r.k * 2) for r in got)


def test_large_group(spark):
    """One group holds most items, by a popular URL and a chain of parents; equal to a union-find over all shared keys."""
    rng = random.Random(3)
    rows = [item(f"i{k:04d}", "http://x.org/hot" if k % 3 else f"http://y.org/{rng.randrange(900)}", f"i{k + 1:04d}" if k % 50 < 25 else None, score=rng.random()) for k in range(1500)]
    keys: dict = {}
    pairs = []
    for k, ((i, *_), (_, url, parent)) in enumerate(rows):
        for key in {("p", i), ("p", parent or i), ("u", url)}:
            pairs.append((k, keys.setdefault(key, k)))
    roots = union(len(rows), pairs)
    want = {tuple(sorted(rows[k][0][0] for k in range(len(rows)) if roots[k] == r)) for r in set(roots)}
    got = D.dedup_groups(spark.createDataFrame(rows, ITEM)).collect()
    assert {tuple(sorted(g.member_post_ids)) for g in got} == want and len(got) == len(want)
    hot = max(got, key=lambda g: g.size)
    assert dict(map(tuple, hot.shared_external_urls))["x.org/hot"] == [f"i{k:04d}" for k in range(1500) if k % 3]
    assert {"same_external_url", "crosspost_parent_in_group"} <= set(hot.duplicate_signals)
