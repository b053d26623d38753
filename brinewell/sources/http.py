"""Posts from a paged web API, as a PySpark data source with one partition per community.

The transport (a function of path and parameters that returns decoded JSON) is
injected, so tests need no network. A community that fails gives one row with
its error; the run goes on.
"""

from __future__ import annotations

import json
import pickle
import time
import urllib.error
import urllib.parse
import urllib.request
from base64 import b64decode, b64encode
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from brinewell.functions.text import drop_kind_prefix
from brinewell.plans.lineage import cut, small

#: Page and lookup sizes, and the bounds of retries.
PAGE, LOOKUP, TRIES, TIMEOUT_S, LEAST_DELAY, MOST_DELAY = 100, 500, 4, 30, 1, 60

Transport = Callable[[str, dict], dict]


class UrlTransport:
    """GET with retries on 429, server errors and broken connections, waiting longer each time."""

    def __init__(self, base: str, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, opener: Callable = urllib.request.urlopen):
        self.base, self.tries, self.sleep, self.opener = base.rstrip("/"), tries, sleep, opener

    def _delay(self, attempt: int, error: Exception) -> float:
        delay = float(2**attempt)
        if not isinstance(error, urllib.error.HTTPError):
            return delay
        if error.code == 429:
            try:
                delay = float(error.headers.get("X-RateLimit-Reset", delay))
            except (TypeError, ValueError):
                pass
        return min(MOST_DELAY, max(LEAST_DELAY, delay))

    def __call__(self, path: str, params: dict) -> dict:
        url = f"{self.base}{path}?{urllib.parse.urlencode(params)}"
        for attempt in range(self.tries):
            try:
                with self.opener(url, timeout=TIMEOUT_S) as answer:
                    return json.loads(answer.read())
            except urllib.error.URLError as e:
                final = isinstance(e, urllib.error.HTTPError) and e.code != 429 and e.code < 500
                if final or attempt + 1 == self.tries:
                    raise
                self.sleep(self._delay(attempt, e))
        raise ValueError("no tries")


def _epoch(row: dict) -> int:
    return int(float(row.get("created_utc") or 0))


def window_rows(transport: Transport, community: str, start: int, end: int) -> Iterator[dict]:
    """Raw rows of [start, end) in order of time, each id once, its last version.

    The cursor stays on the last second while a page brings ids not seen yet,
    so posts that share a second with a page's end are not lost.
    """
    if start >= end:
        raise ValueError("the window must end after it starts")
    rows: dict[str, dict] = {}
    cursor = start
    while cursor < end:
        page = transport("/posts/search", {"subreddit": community, "after": cursor, "before": end, "limit": PAGE, "sort": "asc"}).get("data") or []
        fresh = [r for r in page if str(r["id"]) not in rows]
        for r in page:
            if start <= _epoch(r) < end:
                rows[str(r["id"])] = r
        if not page:
            break
        last = max(map(_epoch, page))
        cursor = last if fresh and last > cursor else max(last, cursor) + 1
    yield from sorted(rows.values(), key=_epoch)


class _Community(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.names = json.loads(options["communities"])
        self.start, self.end = int(options["start"]), int(options["end"])
        self.transport = options["transport"]

    def partitions(self) -> list[InputPartition]:
        return [_Community(n) for n in self.names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            transport = pickle.loads(b64decode(self.transport))
            for row in window_rows(transport, partition.name, self.start, self.end):
                yield partition.name, json.dumps(row), None
        except Exception as e:  # one community's failure is a row, not the run's end
            yield partition.name, None, f"{type(e).__name__}: {e}"


class CommunityPosts(DataSource):
    """Options: communities (JSON list), start and end (epoch seconds), transport (pickled, base64)."""

    @classmethod
    def name(cls) -> str:
        return "community_posts"

    def schema(self) -> str:
        return "community string, row string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def scan_window(spark: SparkSession, transport: Transport, communities: Sequence[str], start: datetime, end: datetime) -> tuple[DataFrame, DataFrame]:
    """Raw rows ``(community, row)`` with row as JSON text, and errors ``(community, error)``, of a half-open window."""
    if start.tzinfo is None or end.tzinfo is None:
        raise ValueError("instants need a time zone")
    if start >= end:
        raise ValueError("the window must end after it starts")
    spark.dataSource.register(CommunityPosts)
    at = lambda t: str(int(t.astimezone(timezone.utc).timestamp()))
    from pyspark import cloudpickle

    options = {"communities": json.dumps(list(communities)), "start": at(start), "end": at(end), "transport": b64encode(cloudpickle.dumps(transport)).decode()}
    both = cut(spark.read.format("community_posts").options(**options).load(), "fetched")  # once, so that no plan asks the web twice
    return both.where("error is null").drop("error"), both.where("error is not null").select("community", "error")


def run_status(errors: DataFrame) -> str:
    return "ok" if errors.isEmpty() else "partial"


def fetch_rows(transport: Transport, ids: Sequence[str]) -> list[dict]:
    """Raw rows of the ids in request order, looked up LOOKUP at a time; unknown ids are left out, repeated ones repeated."""
    bare = [i[3:] if i[:3] in ("t1_", "t3_") else i for i in ids]
    found: dict[str, dict] = {}
    for at in range(0, len(bare), LOOKUP):
        for r in transport("/posts/ids", {"ids": ",".join(bare[at : at + LOOKUP])}).get("data") or []:
            key = str(r["id"])
            found[key[3:] if key[:3] in ("t1_", "t3_") else key] = r
    return [found[i] for i in bare if i in found]


def lookup(posts: DataFrame, ids: DataFrame, id_col: str = "id", strip_prefix: bool = True) -> DataFrame:
    """Posts of the requested ``(pos, id)`` with their ``pos``; the last of repeated posts by ``ord`` where there is one."""
    wanted = ids.select("pos", (drop_kind_prefix(F.col("id")) if strip_prefix else F.col("id")).alias(id_col))
    if "ord" in posts.columns:
        rest = F.struct(*(F.col(c) for c in posts.columns if c != id_col))
        posts = posts.groupBy(id_col).agg(F.max_by(rest, "ord").alias("last__")).select(id_col, "last__.*")
    return posts.join(small(wanted), id_col).orderBy("pos")
