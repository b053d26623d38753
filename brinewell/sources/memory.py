"""Posts and comments held in DataFrames, behind the same calls as the web source."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brinewell.functions.text import fold
from brinewell.sources.http import Transport, fetch_rows, lookup, scan_window
from brinewell.sources.normalize import normalize
from brinewell.sources.schemas import RAW_POST


class PostSource(ABC):
    """Where posts come from."""

    @property
    @abstractmethod
    def provider(self) -> str: ...

    @abstractmethod
    def posts(self, community: str, start: datetime, end: datetime) -> DataFrame: ...

    @abstractmethod
    def posts_by_ids(self, ids: Sequence[str]) -> DataFrame: ...

    @abstractmethod
    def comments(self, post_id: str) -> DataFrame: ...


class TableSource(PostSource):
    """Tables of posts and comments; filters reach the tables' scans."""

    def __init__(self, posts: DataFrame, comments: DataFrame | None = None, provider: str = "table"):
        self._posts, self._comments, self._provider = posts, comments, provider

    @property
    def provider(self) -> str:
        return self._provider

    def posts(self, community: str, start: datetime, end: datetime) -> DataFrame:
        return self._posts.where((fold(F.col("subreddit")) == community.casefold()) & (F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(end)))

    def posts_by_ids(self, ids: Sequence[str]) -> DataFrame:
        rows = self._posts.sparkSession.createDataFrame(list(enumerate(ids)), "pos long, id string")
        return lookup(self._posts, rows, strip_prefix=False).drop("pos")

    def comments(self, post_id: str) -> DataFrame:
        if self._comments is None:
            raise ValueError("this source has no comments")
        return self._comments.where(F.col("post_id") == post_id)


class WebSource(PostSource):
    """The web API behind the same calls; it has no comments."""

    def __init__(self, spark: SparkSession, transport: Transport, provider: str = "web"):
        self.spark, self.transport, self._provider = spark, transport, provider

    @property
    def provider(self) -> str:
        return self._provider

    def _typed(self, rows: DataFrame) -> DataFrame:
        return normalize(rows.select(F.from_json("row", RAW_POST).alias("r")).select("r.*"), self._provider)

    def posts(self, community: str, start: datetime, end: datetime) -> DataFrame:
        rows, errors = scan_window(self.spark, self.transport, [community], start, end)
        failed = errors.first()
        if failed:
            raise RuntimeError(failed["error"])
        return self._typed(rows).orderBy("created_at")

    def posts_by_ids(self, ids: Sequence[str]) -> DataFrame:
        import json

        rows = [(k, json.dumps(r)) for k, r in enumerate(fetch_rows(self.transport, ids))]
        return self._typed(self.spark.createDataFrame(rows, "pos long, row string").orderBy("pos"))

    def comments(self, post_id: str) -> DataFrame:
        raise NotImplementedError("the web source has no comments")
