import random
import re
import urllib.parse
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from brinewell.functions import text, times, urls
from brinewell.operators.screening import GIVEAWAY, GIVEAWAY_WORDS, ROUTINE, SPAM, SPAM_WORDS


@pytest.mark.parametrize(
    "url, want",
    [
        (None, None), ("", None), ("  ", None), ("ftp://a.com/x", None), ("/rel", None), ("http://[bad/", None), ("http://a.com:99999/", None),
        ("http://www.Example.com:80/a//?b=2&A=1&utm_x=1#f", "example.com/a?A=1&b=2"),
        ("https://example.com", "example.com/"), ("http://example.com/", "example.com/"),
        ("https://example.com:8443/x/", "example.com:8443/x"), ("https://example.com:80/x", "example.com:80/x"),
        ("https://e.com/x?source=a&ref=b&ref_src=c&k=", "e.com/x?k=&ref=b"), ("http://u:p@e.com/x", "e.com/x"), ("http://e.com/x?q=a%20b", "e.com/x?q=a+b"),
    ],
)
def test_canonical(url, want):
    assert urls.canonical(url) == want


def test_canonical_ignores_what_only_tracks():
    rng = random.Random(3)
    for _ in range(300):
        pairs = [(rng.choice("abC"), rng.choice(["1", "x y", "é"])) for _ in range(rng.randrange(4))]
        noise = [(rng.choice(["utm_a", "UTM_b", "fbclid", "source"]), "9") for _ in range(rng.randrange(3))]
        mixed = pairs + noise
        rng.shuffle(mixed)
        base = f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'www.'])}H.org/p"
        a = urls.canonical(f"{base}?{urllib.parse.urlencode(mixed)}#z")
        assert a == urls.canonical(f"http://h.org/p/?{urllib.parse.urlencode(sorted(pairs))}")


def test_strip_and_patterns_are_those_of_python(spark):
    rng = random.Random(1)
    pieces = ["give", "away", " ", " ", "giveaway", "é", "_", "́", "\x1c", "\n", "x", "buy", "upvotes", "whatsapp", "dm", "weekly", "thread", "ſweepstakes", "self-promo", "GİVEAWAY", "."]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(1500)]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, s string")
    got = df.select("k", text.strip(F.col("s")).alias("t"), text.matches(F.col("s"), *GIVEAWAY, needs=GIVEAWAY_WORDS).alias("g"), text.matches(F.col("s"), *SPAM, needs=SPAM_WORDS).alias("p"), text.matches(F.col("s"), *ROUTINE).alias("r")).orderBy("k").collect()
    for row, s in zip(got, rows, strict=True):
        assert row.t == s.strip()
        for flag, patterns in ((row.g, GIVEAWAY), (row.p, SPAM), (row.r, ROUTINE)):
            assert flag == any(re.search(p, s, re.I) for p in patterns), s


def test_parse_instant(spark):
    df = spark.createDataFrame([(0, "1700000000"), (1, " 1700000000.5 "), (2, "2026-01-02T03:04:05Z"), (3, "2026-01-02T03:04:05+02:00")], "k int, s string")
    got = [r[0] for r in df.select(times.iso_utc(times.parse_instant(F.col("s")))).collect()]
    assert got == ["2023-11-14T22:13:20Z", "2023-11-14T22:13:20.500000Z", "2026-01-02T03:04:05Z", "2026-01-02T01:04:05Z"]
    with pytest.raises(Exception, match="unsupported instant"):
        spark.createDataFrame([("soon",)], "s string").select(times.parse_instant(F.col("s"))).collect()
    for part in ("2026-01", "12:30", "2026-1-2"):
        with pytest.raises(Exception, match="unsupported instant"):
            spark.createDataFrame([(part,)], "s string").select(times.parse_instant(F.col("s"))).collect()


@pytest.mark.parametrize("monday, hours", [("2026-03-23", 167), ("2026-10-19", 169), ("2026-06-01", 168)])
def test_week_window(spark, monday, hours):
    start, end, start_utc, end_utc = times.week_window(monday)
    assert (end_utc - start_utc).total_seconds() == hours * 3600
    df = spark.createDataFrame([(start_utc,)], "t timestamp")
    a, b = df.select(times.iso_utc(times.week_start(F.col("t"))), times.iso_utc(times.week_end(F.col("t")))).first()
    assert (a, b) == (start_utc.strftime("%Y-%m-%dT%H:%M:%SZ"), end_utc.strftime("%Y-%m-%dT%H:%M:%SZ"))


def test_week_window_defaults_to_the_last_complete_week():
    start, *_ = times.week_window(now=datetime(2026, 9, 15, 12, tzinfo=timezone.utc))
    assert start.date().isoformat() == "2026-09-07"
    with pytest.raises(ValueError):
        times.week_window("2026-09-08")
