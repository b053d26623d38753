import random
import re

import pytest
from pyspark.sql import functions as F

from brinewell.llm import chat, pii
from brinewell.llm import decontaminate as D

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[ -]", "", m)) <= 19 and luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    spans = sorted((m.start(), k, m.end()) for k, (_, rx, ok) in enumerate(KINDS) for m in re.finditer(rx, text or "") if ok(m[0]))
    return ",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans)


def found(spark, texts):
    df = spark.createDataFrame([(k, t, "x", 1, 2, 3) for k, t in enumerate(texts)], "doc_id int, text string, id string, row int, base int, left int")
    return {r.id: (r.b, r.s) for r in pii.personal_data(df).select("id", pii.span_list(F.col("base")).alias("b"), pii.span_list(F.col("spans")).alias("s")).collect()}


def test_base_spans_are_those_of_brute_force(spark):
    rng = random.Random(2)
    pieces = ["a", "b.c", "@", "x@y.z", "_w@q.r", "1", "255", "256", ".", "1.2.3.4", "00012.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+", "(", ")", " ", "-", "é", "😀", "\n", "12345678901234", "0" * 40, "9" * 30 + ".1.1.1"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)] + [None, "", "4" * 30_000, "a" * 50_000 + "@b.c", "1 " * 20_000, "+1" + "(" * 40_000, "x@y.z " * 3000]
    got = found(spark, texts)
    for k, t in enumerate(texts):
        assert got[k][0] == base(t), t
        assert set(got[k][0].split(",")) - {""} <= set(got[k][1].split(","))


def test_contexts_of_seeds_discover_unseen_identifiers(spark):
    texts = [f"please reach: user{k}@mail.org today" for k in range(8)] + ["write to reach: user-77-at-mail when free", "nothing with a1b2c3d4 here", "the number of 12345678 things"]
    texts += [f"the {w} of the sea" for w in ("depth", "colour", "name")] + [f"the 1.2.3.{k} host" for k in range(5)]
    got = found(spark, texts)
    assert got[8][1] == "id:16:31" and texts[8][16:31] == "user-77-at-mail"
    assert got[9][1] == "" and got[10][1] == ""


def test_every_shape_of_pattern_discovers(spark):
    """Two tokens (``key =``), the token after, a label that is itself a token with a digit, and keys of letters and digits."""
    keys = [f'x token = "{random.Random(k).getrandbits(160):040x}" y' for k in range(4)]
    texts = [*keys, 'say token = "hunter2x" now', "a = b and c = d", "token ring", *(f"{k}k5@mail.org wrote: hi" for k in range(4)), "then acct-9921 wrote: hi", *(f"acct2:u{k}@m.org" for k in range(4)), "acct2:X93847", f"commit {0xABC1 << 140:x}0 pushed"]
    got = found(spark, texts)
    plain = [[texts[k][int(a) : int(b)] for _, a, b in (x.split(":") for x in got[k][1].split(",") if x)] for k in range(len(texts))]
    assert [x[0] for x in plain[:4]] == [t[11:51] for t in keys]
    assert plain[4] == ["hunter2x"] and plain[5] == plain[6] == [] and plain[11] == ["acct-9921"] and plain[16] == ["X93847"] and plain[17] == []


def test_what_is_discovered_discovers_more(spark):
    """A pattern that stands next to discovered identifiers only is found in the next round."""
    texts = [f"reach: m{k}@mail.org end" for k in range(4)] + [f"reach: badge-{k}7 end" for k in range(3)] + [f"holder badge-{k}7 left" for k in range(3)] + ["holder badge-97 left", "other badge-87 left"]
    got = found(spark, texts)
    assert got[10][1] == "id:7:15" and got[5][1] == "id:7:15"


def test_long_texts_cost_in_proportion(spark):
    """A megabyte of identifier tokens, of base spans, and their masks."""
    import time

    texts = ["key5x " * 170_000, "a@b.co " * 150_000, "é +1 (988) 555-2485 " * 50_000]
    began = time.perf_counter()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.personal_data(df).select(F.col("id").alias("doc_id"), "spans")
    got = df.join(rows, "doc_id").select("doc_id", F.size("spans").alias("n"), pii.mask(F.col("text"), F.col("spans")).alias("m")).orderBy("doc_id").collect()
    assert [r.n for r in got] == [0, 150_000, 50_000] and got[1].m == "<EMAIL> " * 150_000 and got[2].m == "é <PHONE> " * 50_000
    assert time.perf_counter() - began < 90


def test_repeated_rows_empty_tables_and_masks(spark):
    df = spark.createDataFrame([(1, "é a@b.c +1 (988) 555-2485."), (1, "é a@b.c +1 (988) 555-2485."), (None, None)], "doc_id long, text string")
    rows = pii.personal_data(df)
    assert rows.count() == 3 and pii.personal_data(df.limit(0)).count() == 0
    one = df.limit(1).crossJoin(rows.where("id = 1").limit(1)).select(pii.mask(F.col("text"), F.col("spans")).alias("m"), pii.mask(F.lit("plain"), F.array().cast(rows.schema["spans"].dataType)).alias("p"))
    assert tuple(one.first()) == ("é <EMAIL> <PHONE>.", "plain")


def naive(docs, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in docs:
        w, hit, got = split(t), set(), set()
        for item, text in items:
            v = split(text)
            n = min(size, len(v))
            for a in range(len(v) - n + 1 if n and item is not None else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        got.add(str(item))
        out.append((i, len(w), sorted(hit), sorted(got)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, held", [(1_000_000, 500_000), (12, 3)])
def test_matches_are_those_of_brute_force(spark, monkeypatch, block, held):
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    monkeypatch.setattr(D, "CANDIDATES", held)
    monkeypatch.setattr(D, "SHARD_WORDS", 2000 * held)
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "a", "É", "x1", "rare", "q"])
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 16)))) for k in range(12)] + [(12, None), (13, ""), (None, "the of"), (3, "Q-Q-q"), (14, "the " * 11)]
    docs = [(k, ", ".join(word() for _ in range(rng.randrange(60)))) for k in range(40)] + [(40, None), (41, ""), (42, items[0][1] + " rare"), (42, items[0][1]), (43, "the " * 3000), (None, items[1][1])]
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, row int, id int, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.id, r.n_words, list(r.hits), list(r.items)) for r in D.benchmark_matches(frame, bench).collect()), key=repr)
    assert got == naive(docs, items)
    dealt = D.benchmark_matches(frame.repartition(7, "text"), bench)  # blocks meet by rows of an input that comes out of a shuffle
    assert sorted(((r.id, r.n_words, list(r.hits), list(r.items)) for r in dealt.collect()), key=repr) == got
    assert D.benchmark_matches(frame.limit(0), bench).count() == 0
    assert {(r.n_words > 0, len(r.hits)) for r in D.benchmark_matches(frame, bench.limit(0)).collect()} == {(True, 0), (False, 0)}


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta of the of the of the")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "delta x gamma y beta z alpha"), (2, "delta gamma beta " + "x " * 50 + "alpha"), *((k, "of the of the") for k in range(3, 9))], "doc_id long, text string")
    got = {r.id: (r.items, r.near_items) for r in D.benchmark_matches(docs, bench, slop=12).collect()}
    assert got[1] == ([], ["1"]) and got[2] == ([], [])


def test_proximity_query_finds_swapped_words(spark, tmp_path):
    import corpus_pipeline
    from brinewell.llm import queries as Q

    words = [f"w{k}" for k in range(30)]
    swapped = [w for k in range(0, 30, 6) for w in (words[k + 1], words[k], *words[k + 2 : k + 6])]
    spark.createDataFrame([(7, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, " ".join(swapped)), (2, " x ".join(words)), (3, " ".join(words)), (4, "w1 " + "x " * 40 + "w2")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_items, r.near_items) for r in Q.queries()["op4_decontaminate"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, "7"), 2: (0, "7"), 3: (1, "7"), 4: (0, "")}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [4]


@pytest.mark.parametrize("held", [500_000, 3])
def test_proximity_is_that_of_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(D, "CANDIDATES", held)
    rng = random.Random(8)
    word = lambda: f"w{int(rng.random() ** 2 * 40)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 14)))) for k in range(30)]
    docs = [(k, " ".join(word() for _ in range(rng.randrange(50)))) for k in range(60)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seen = {w: sum(w in t.split() for _, t in docs) for _, x in items for w in x.split()}
    want = {}
    for i, t in docs:
        w, near = t.split(), set()
        for item, text in items:
            v = text.split()
            for at in range(max(1, len(v) - 9)):
                rare = set(sorted(v[at : at + 10], key=lambda x: seen[x])[: D.NEAR_TERMS])
                near |= {str(item)} if any(rare <= set(w[p : p + 6]) for p in range(len(w))) else set()
        want[i] = sorted(near)
    assert {r.id: list(r.near_items) for r in D.benchmark_matches(frame, bench, slop=6).collect()} == want
    assert sum(map(len, want.values())) > 30


def test_chats_round_trip(spark):
    rng = random.Random(5)
    nasty = ["<|end|>\n", "<|", "|>", "<|user|>\n", "&lt;|", "&amp;", "&", "<s>", "</s>", "[INST]", "[/INST]", "&lsqb;", "<", "|", ">", "[", "é😀", "\n", "", None, " ok "]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "tool|", "a|>\nb", None]), None if rng.random() < 0.05 else "".join(rng.choice(nasty) or "" for _ in range(rng.randrange(8)))) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for t in range(1500)] + [(51, None, "assistant", "last"), (51, 3, "user", "first"), (51, 3, "user", "first"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, kind string")
    out = {r.conv_id: r for r in chat.format_chats(chat.events_from_turns(df)).select("*", chat.parse_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("plain")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c), key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        assert [(t.role, t.text) for t in out[c].turns] == [(r, x) for *_, r, x in own]
        assert out[c].plain == "".join(x for *_, r, x in own if r == "assistant") and len(out[c].loss) == sum(r == "assistant" for *_, r, _ in own)
        assert all(out[c].formatted[: s.start].endswith("<|assistant|>\n") for s in out[c].loss) and all(out[c].formatted[s.end :].startswith("<|end|>\n") for s in out[c].loss)
        assert out[c].formatted.count("<|") == 2 * len(own) and "</s>" not in out[c].formatted and "[INST]" not in out[c].formatted
    assert chat.format_chats(chat.events_from_turns(df.limit(0))).count() == 0


def test_events_are_folded(spark):
    log = [(1, 0, 0, 0, "message", "user", "hi"), (1, 1, 1, 3, "delta", None, "lo"), (1, 1, 1, 2, "delta", None, "hel"), (1, 1, 1, 1, "message", "assistant", None), (1, 2, 2, 0, "message", "assistant", "bad"), (1, 2, 2, 2, "delta", None, "good"), (1, 2, 2, 1, "regenerate", None, ""), (1, 3, 3, 0, "message", "user", "old"), (1, 3, 3, 1, "edit", None, "new")]
    got = chat.fold_events(spark.createDataFrame(log, "conv_id long, turn long, message long, seq long, kind string, role string, text string")).orderBy("turn").collect()
    made = chat.events_from_turns(spark.createDataFrame([(1, 0, "user", "abcdef"), (1, 1, "assistant", "uvwxyz12")], "conv_id long, turn long, role string, text string"))
    kinds = {(r.turn, r.kind) for r in made.collect()}
    assert {(0, "message"), (0, "edit"), (1, "message"), (1, "delta"), (1, "regenerate")} == kinds and made.where("turn = 0").agg(F.max("seq")).first()[0] > made.where("turn = 1").agg(F.min("seq")).first()[0]
    assert [(r.role, r.text) for r in chat.fold_events(made).orderBy("turn").collect()] == [("user", "abcdef"), ("assistant", "uvwxyz12")]
    assert [(r.role, r.text) for r in got] == [("user", "hi"), ("assistant", "hello"), ("assistant", "good"), ("user", "new")]
