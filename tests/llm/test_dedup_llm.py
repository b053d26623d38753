import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brinewell.llm import near_dedup as N
from brinewell.llm.text import shingle_set, word_hashes

DOCS = "doc_id long, text string, id string, key int, rep string"


def brute(docs, size, percent):
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = {i: i for i, _ in docs if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(docs)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and docs[x][0] is not None and docs[y][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                i, j = sorted((find(docs[x][0]), find(docs[y][0])))
                root[j] = i
    return sorted(((i, len(s), None if i is None else i if not s else find(i)) for (i, _), s in zip(docs, sets, strict=True)), key=repr)


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("few, block_bytes", [(8, 16 << 20), (1, 4000)])
def test_components_are_those_of_brute_force(spark, monkeypatch, few, block_bytes):
    """Families whose members lie on both sides of the threshold, with large bands split into many blocks."""
    monkeypatch.setattr(N, "FEW", few)
    monkeypatch.setattr(N, "BLOCK_BYTES", block_bytes)
    rng = random.Random(7)
    texts = [None, "", "  \n", "one", "One", "a b c", "a b c", "A  b\tC", "x y z w", "é Ü é ß", "é ü é ß"]
    for k in range(4):
        texts += family(rng, [f"w{k}_{rng.randrange(200)}" for _ in range(60 + 40 * k)], 45, 14)
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = list(zip(ids, texts, strict=True)) + [(ids[4], "again under one id"), (ids[4], "One"), (None, "one")]
    rows = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], DOCS)
    got = N.near_duplicates(rows, size=4, percent=80).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(docs, 4, 80)
    assert all(r.kept == (r.id is None or r.id == r.component_id) for r in got)


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_an_id_with_texts_that_have_different_near_copies(spark):
    """Links of every text of a repeated id count; without ids, texts alone link and one row of each component is first."""
    rng = random.Random(3)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(100)] for x in "ab")
    near = lambda w: " ".join([*w[:-1], "end"])
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, near(b)), (3, near(a)), (1, " ".join(a)), (None, near(a)), (None, None), (4, "alone here")]
    rows = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in docs], DOCS)
    got = {(r.id, r.n_shingles): r for r in N.near_duplicates(rows, size=4).collect()}
    assert [got[i, 97].component_id for i in (1, 2, 3)] == [1, 1, 1] and not got[2, 97].kept and got[None, 97].kept and got[None, 97].component_id is None
    out = N.near_duplicates(rows, size=4, by_id=False).collect()
    firsts = [(r.id, r.n_shingles) for r in out if r.first]
    assert len(out) == 8 and len(firsts) == 4 and {(None, 0), (4, 1)} < set(firsts)
    assert sorted(r.component_id for r in out if r.n_shingles == 97) == [1] * 6


def test_a_large_exact_group_and_a_long_text(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    docs = [(k, "the same words in every one") for k in range(500)] + [(900, long), (901, long + " end")]
    got = {r.id: r.component_id for r in N.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {got[k] for k in range(500)} == {0} and got[901] == 900


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(0)
    for overlap in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(30):
            n = int(rng.integers(100, 4000))
            both = int(2 * n * overlap / (1 + overlap))
            pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = pool[:n], pool[n - both :]
            c = n.bit_length() - 1
            chance = N.chance_of_equal_registers(n * N.repeats(c) / N.REGISTERS, n * N.repeats(c) / N.REGISTERS)
            errors.append(N.estimate(N.sketch(a, c), N.sketch(b, c), chance) - both / (2 * n - both))
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


@pytest.mark.parametrize("n", [256, 450])
def test_pairs_at_the_threshold_share_a_band(n):
    """10,000 pairs at 0.8: bands that shared registers left about ten of them without a common band."""
    rng = np.random.default_rng(n)
    both, c, missed = 8 * n // 9, n.bit_length() - 1, 0
    for _ in range(10_000):
        pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        a, b = (set(N.band_keys(N.sketch(s, c), c)) for s in (pool[:n], pool[n - both :]))
        missed += not a & b
    assert missed <= 2


def test_partners_share_a_size_class():
    for n in range(1, 3000):
        for m in range(n, int(n / 0.8) + 1):
            assert set(N.size_classes(n, 0.8)) & set(N.size_classes(m, 0.8))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=3), max_size=12), st.integers(1, 5))
def test_shingle_sets_count_distinct_shingles(words, size):
    want = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} if words else set()
    assert len(shingle_set(" ".join(words), size)) == len(want)
    assert len(set(word_hashes([w.encode() for w in words]).tolist())) == len(set(words))
