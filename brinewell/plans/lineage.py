"""Lineage cuts through the shared folder and size-checked broadcasts.

Iterative plans write their intermediate tables as Parquet under
``spark.checkpoint.dir``, which the driver and every executor share, so a lost
executor costs a re-read and not a re-computation of the whole loop.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcast bounds: rows, and bytes of their text form, of a side that may be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_LOCAL: dict[str, str] = {}
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="brinewell-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the tables that were cut inside; what is still needed must have been written elsewhere."""
    before = len(_MADE)
    try:
        yield
    finally:
        for folder in _MADE[before:]:
            _delete(spark, folder)
        del _MADE[before:]


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_alone(spark: SparkSession, make: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """What ``make`` returns, cut; the tables that were cut to make it are deleted."""
    path = new_path(spark, name)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
        schema = df.schema
    return spark.read.schema(schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`cut` that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows and ``size`` bytes, else ``df`` for a shuffled join.

    Both are measured on the data at hand, so the hint can never ship a side
    that has grown past a bound. The plan of ``df`` is run for that; a side that
    costs more than a scan should be cut first.
    """
    held = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))).alias("b")).first()
    return F.broadcast(df) if held.n <= rows and (held.b or 0) <= size else df
