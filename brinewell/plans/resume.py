"""Resumable runs: results by batch, a manifest of what they were made from, and guards."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def check_run(full: bool, max_posts: int | None = None, max_batches: int | None = None, status_only: bool = False) -> None:
    """A run names its bound, or says that it is full; not both."""
    if status_only:
        return
    bounded = max_posts is not None or max_batches is not None
    if full and bounded:
        raise ValueError("a full run has no bound")
    if not full and not bounded:
        raise ValueError("name a bound or ask for a full run")
    if any(x is not None and x <= 0 for x in (max_posts, max_batches)):
        raise ValueError("bounds must be positive")


def expect_count(n: int, expected: int | None) -> int:
    """Raise if a stage's count differs from the one that a caller froze; None expects nothing."""
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows, not {expected}")
    return n


class ResumableRun:
    """Batches appended to a table under ``path``, with a manifest that a later run must match.

    Everything is read and written by Spark, so ``path`` can be in any store.
    """

    def __init__(self, spark: SparkSession, path: str, fingerprints: dict[str, str], total: int, batch_size: int):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = {"version": VERSION, "source": dict(sorted(fingerprints.items())), "total": total, "batch_size": batch_size}

    def _exists(self, name: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def open(self, ids: DataFrame) -> None:
        """Start, or check that an earlier run was of the same version, inputs, counts and ids."""
        if not self._exists("manifest"):
            self.spark.createDataFrame([(json.dumps(self.manifest),)], "value string").coalesce(1).write.text(f"{self.path}/manifest")
            return
        old = json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifest").collect()))
        for k, v in self.manifest.items():
            if old.get(k) != v:
                raise ValueError(f"the earlier run differs in {k}")
        done = self.done()
        if done is not None:
            if not done.groupBy("post_id").count().where("count > 1").isEmpty():
                raise ValueError("the earlier run has an id twice")
            if not done.join(ids.select("post_id"), "post_id", "left_anti").isEmpty():
                raise ValueError("the earlier run has ids that are unknown here")

    def done(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/results") if self._exists("results/_SUCCESS") else None

    def pending(self, inputs: DataFrame) -> DataFrame:
        done = self.done()
        return inputs if done is None else inputs.join(done.select("post_id"), "post_id", "left_anti")

    def append(self, rows: DataFrame) -> None:
        """Add results; a failed write leaves nothing."""
        rows.write.mode("append").parquet(f"{self.path}/results")

    def step(self, inputs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> None:
        """Do the work on what is pending and append it."""
        self.append(work(self.pending(inputs)))

    def status(self, totals: Sequence[str] = ()) -> dict:
        """Posts done and asked for, and of results by batch (``pos`` is a post's place in it) the batches and sums of ``totals``."""
        done = self.done()
        out = {"posts_completed": 0 if done is None else done.count(), "total": self.manifest["total"]}
        out["complete"] = out["posts_completed"] == out["total"]
        if totals:
            sums = [F.count_if(F.col("pos") == 0).alias("batches_completed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals)]
            row = {} if done is None else done.agg(*sums).first().asDict()
            out |= {"batches_completed": row.get("batches_completed", 0), "usage": {c: row.get(c, 0) for c in totals}}
        return out


def table_fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows that does not depend on their order."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1]}"
