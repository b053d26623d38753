import random
from math import comb

import pytest
from pyspark.sql import functions as F

from brinewell.llm import curriculum as M
from brinewell.llm import quality as Q

DOCS = "doc_id long, text string, lang string, id int, stratum string, mark string, good int"


def brute_stats(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    words = "".join("\n" if c in space else c for c in text).split("\n")
    words = [w for w in words if w]
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
    seen, dup = [], 0
    for line in text.split("\n"):
        if line.strip(space):
            dup += line in seen
            seen.append(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_stats_are_those_of_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", "é", " ", "\n", " ", "\x1c", "#", "|", "\t", "A", "😀", "a b c "]) for _ in range(rng.randrange(60)))
        s = Q.text_stats(t)
        assert (s[0], s[1], s[2], s[4], s[5]) == brute_stats(t), t
    assert Q.text_stats(None) == (0,) * 8


def test_binomial_cdf():
    for n, k, p in ((10, 3, 0.2), (200, 1, 0.01), (50, 0, 0.1), (5, 5, 0.5)):
        assert Q.binomial_cdf(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def make(spark, good, bad, poor_good=0):
    rng = random.Random(1)
    clean = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    junk = lambda: " ".join(f"###{rng.randrange(10**6)}" for _ in range(60))
    rows, labels = [], []
    for k in range(good + bad):
        poor = k >= good or k < poor_good
        rows.append((k, junk() if poor else clean(), "en", 1, "x", "y", 2))
        labels.append((k, int(k < good), 0, "x"))
    rows += [(10**6, junk(), "en", 1, "x", "y", 2), (10**6 + 1, clean(), "en", 1, "x", "y", 2), (10**6 + 2, junk(), "xx", 1, "x", "y", 2), (10**6 + 3, None, None, 1, "x", "y", 2), (10**6 + 4, "short", "en", 1, "x", "y", 2), (10**6 + 5, "a b c " * 40, "en", 1, "x", "y", 2)]
    docs = spark.createDataFrame(rows, DOCS)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, lang string")


def verdicts(docs, labels):
    return {r.id: (r.base_failed, r.kept) for r in Q.quality_rules(docs, labels).collect()}


def test_certified_cutoffs_reject_junk(spark):
    got = verdicts(*make(spark, 1600, 40))
    assert got[10**6] == (False, False) and got[10**6 + 1] == (False, True)
    assert got[10**6 + 2] == (False, True)  # a stratum without labels keeps what passes the base
    assert got[10**6 + 3] == got[10**6 + 4] == got[10**6 + 5] == (True, False)
    assert not any(k for i, (_, k) in got.items() if 1600 <= i < 1640) and all(got[i][1] for i in range(1600))


def test_certified_cutoffs_are_those_of_the_sql(spark):
    """The query's SQL on labels that certify cutoffs, which the small tables' do not."""
    import duckdb

    from brinewell.llm.oracles import ORACLES

    docs, labels = make(spark, 1600, 400)
    got = Q.quality_rules(docs, labels).collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    want = con.execute(ORACLES["op1_quality_rules"]).fetchall()
    mine = [(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got]
    assert sorted(mine) == sorted(want) and any(r.failed_rules and not r.base_failed for r in got)


def test_few_labels_or_false_rejections_certify_nothing(spark):
    assert all(k for i, (b, k) in verdicts(*make(spark, 100, 40)).items() if not b)
    assert all(k for i, (b, k) in verdicts(*make(spark, 1600, 40, poor_good=30)).items() if not b)


def test_labels_that_disagree_or_lack_do_not_count(spark):
    docs, labels = make(spark, 20, 5)
    extra = spark.createDataFrame([(0, 0, 0, "x"), (None, 1, 0, "x"), (1, None, 0, "x"), (1, 7, 0, "x")], labels.schema)
    assert len(verdicts(docs, labels.union(extra))) == docs.count()
    assert Q.quality_rules(docs.union(docs), labels).count() == 2 * docs.count()
    assert Q.quality_rules(docs.limit(0), labels).count() == 0 and len(verdicts(docs, labels.limit(0))) == docs.count()


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def mixed(spark, rows):
    return M.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string, size int, rank string, bucket int, base int, position double"))


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 8)
    rng = random.Random(3)
    rows = [(k, " ".join("w" * 1 for _ in range(rng.randrange(1, 40))), rng.choice(["a", "a", "a", "a", "b", "c", "d", "é", None]), 1, "x", 2, 3, 0.5) for k in range(900)]
    rows += [(1000, None, "a", 1, "x", 2, 3, 0.5), (1001, "", "z", 1, "x", 2, 3, 0.5), (None, "w w", "a", 1, "x", 2, 3, 0.5), rows[5], rows[5]]
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((x[1] or "").split()) for x in rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute_targets(sizes)
    for s, n in sizes.items():
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {n} and own[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in own) - want[s]) <= 20.5
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size and len(r.positions) == r.copies and all(0 <= p <= 1 for p in r.positions)
    first = [r.positions[0] for r in got if r.positions]
    assert first == sorted(first) and not any(r.positions for r in got[len(first) :])
    again = mixed(spark, rows[::-1]).collect()
    assert [(r.id, r.size, r.taken, r.positions) for r in got] == [(r.id, r.size, r.taken, r.positions) for r in again]


def test_mix_of_nothing(spark):
    assert mixed(spark, []).count() == 0
    assert [r.taken for r in mixed(spark, [(1, None, None, 1, "x", 2, 3, 0.5)]).collect()] == [0]


def test_schedules_shift_sources_in_time(spark):
    """Early training holds more of the source whose weight falls than late training does."""
    rows = [(k, "w " * 10, "ab"[k % 2], 1, "x", 2, 3, 0.5) for k in range(2000)]
    order = M.training_order(spark.createDataFrame(rows, "doc_id long, text string, source string, size int, rank string, bucket int, base int, position double")).collect()
    assert len(order) == sum(r.copies for r in mixed(spark, rows).collect()) and order[0].asDict().keys() == {"doc_id", "text", "source", "size", "rank", "bucket", "base", "copy", "position"}
    assert [r.position for r in order] == sorted(r.position for r in order)
    head, tail = order[: len(order) // 4], order[-len(order) // 4 :]
    assert sum(r.source == "a" for r in head) / len(head) > sum(r.source == "a" for r in tail) / len(tail) + 0.1


def test_rows_without_ids_and_repeated_rows_are_spread(spark):
    """Null ids lie in as many buckets as others; rows that agree in all are taken one by one and come out once each."""
    rows = [(None, f"text {k} here", "a", 1, "x", 2, 3, 0.5) for k in range(3000)] + [(7, "the same row", "b", 1, "x", 2, 3, 0.5)] * 900 + [(7, "another", "b", 1, "x", 2, 3, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, rank string, bucket int, base int, position double")
    got = M.curriculum(df).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got if r.source == "a") == pytest.approx(got[0].target if got[0].source == "a" else 11_000, rel=0.5)
    ranks = {r.bucket for r in df.select(F.substring(M._rank("doc_id", "text", 0), 1, 2).alias("bucket")).collect()}
    assert len(ranks) > 200
    order = M.training_order(df)
    assert order.count() == sum(r.copies for r in got) and order.where("source = 'b'").select("text", "copy").distinct().count() == order.where("source = 'b'").count()


def test_inverse_schedule(spark):
    for knots in (*M.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (0.5, 0.5), (1.0, 0.5))):

        def area(t):
            total = 0.0
            for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
                u = min(max(t, t0), t1)
                w = w0 + (w1 - w0) * (u - t0) / (t1 - t0)
                total += (w0 + w) / 2 * (u - t0)
            return total

        df = spark.range(101).select((F.col("id") / 100).alias("s")).select("s", M.inverse_schedule(F.col("s"), knots).alias("t"))
        for r in df.collect():
            assert area(r.t) / area(1.0) == pytest.approx(r.s, abs=1e-9)
