"""Every query against its SQL, and the pipeline against plain definitions of its stages, on the smallest tables."""

import os
import re

import duckdb
import pytest

import corpus_pipeline as P
from brinewell.llm import queries as Q
from brinewell.plans.lineage import shared_dir

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    rows = Q.queries()[name](spark, SF)
    sql = Q.oracle_sql().get(name)
    got = [tuple(r) for r in rows.collect()]
    assert got and len(set(rows.columns)) == len(rows.columns)
    if sql:
        con = duckdb.connect()
        for t in ("documents", "pages", "benchmark", "labels", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(rows.columns)
        order = [rows.columns.index(n) for n in names]
        assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[k] for k in order)) for r in got)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language", "near_dedup", "decontaminate", "pii", "mix"] and P.ORACLE_SQL is None
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 10]) for w in map(split, bench) for k in range(max(1, len(w) - 9))}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.mode("overwrite").parquet(f"{shared_dir(spark)}/test-{name}")
        docs = spark.read.parquet(f"{shared_dir(spark)}/test-{name}")
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if name != "mix":
            assert tuple(docs.columns) == P.COLUMNS and len(after) == len(ids)
        if name == "language":
            assert all(re.search(r"[^\W\d_]", r.text or "") for r in after) and len(ids) == len(before)
        elif name == "near_dedup":
            own = lambda t: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(max(1, len(w) - 4))}
            sets = {i: own(r.text) for i, r in before.items()}
            near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            assert not any(near(a, b) for a in ids for b in ids if a < b)
            assert all(any(near(a, b) for b in before if b != a) for a in before if a not in ids)
        elif name == "decontaminate":
            bad = {i for i, r in before.items() if any(tuple(split(r.text)[k : k + 10]) in windows for k in range(max(0, len(split(r.text)) - 9)))}
            assert ids == set(before) - bad and bad
        elif name == "pii":
            assert ids == set(before) and not any(re.search(r"[\w.]+@[\w-]+\.\w", r.text) for r in after)
            changed = [r for r in after if r.text != before[r.doc_id].text]
            assert changed and all(r.n_chars == len(r.text) for r in changed)
        else:
            assert docs.columns == [*P.COLUMNS, "copy", "position"] and len(after) > len(before)
    clash = spark.createDataFrame([(None, "some words of plain english text", None, None, None, 1, 2, 3), (1, None, None, None, None, 1, 2, 3)], "doc_id long, text string, lang string, source string, n_chars long, key int, copy int, position int")
    for _, stage in P.STAGES:
        assert stage(spark, clash, SF).count() in (1, 2, 4) and stage(spark, clash.limit(0), SF).count() == 0


def test_stages_tell_texts_of_one_id_apart(spark):
    """One id with two texts, exact repeats, null ids, a null text: what is told apart stays, what is the same is one document."""
    rng = __import__("random").Random(1)
    text = lambda: " ".join(f"word{rng.randrange(10**5)}" for _ in range(40))
    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (1, a), (2, b + " end"), (None, c), (None, d), (None, d), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id or 0, r.text) for r in P.near_dedup(spark, docs, SF).where("text is not null").collect())[:2] in ([(0, x), (0, y)] for x, y in ([c, d], [d, c]))
    left = [r.text for r in P.near_dedup(spark, docs, SF).collect()]
    assert len(left) == 5 and {a, c, d, None} < set(left)
    assert P.language(spark, docs, SF).count() == 7 and P.language(spark, docs.withColumn("lang", docs.source.substr(9, 1).cast("string")), SF).count() == 7
    assert P.decontaminate(spark, docs, SF).count() == P.pii(spark, docs, SF).count() == 8
    mixed = P.mix(spark, docs, SF).collect()
    assert {r.text for r in mixed} <= {a, b, c, d, b + " end", None} and len(mixed) >= 7
