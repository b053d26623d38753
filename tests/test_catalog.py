"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from brinewell import catalog
from brinewell.plans.lineage import cut, new_path, scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    rows = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in rows.collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(rows.columns)
    order = [rows.columns.index(n) for n in names]
    assert sorted(map(repr, found.fetchall())) == sorted(repr(tuple(r[k] for k in order)) for r in got)


def test_entry_needs_no_session_to_import():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.entry and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0


def test_scratch_tables_go(spark):
    kept = new_path(spark, "kept")
    with scratch(spark):
        cut(spark.range(3), "inside").write.parquet(kept)
        inside = cut(spark.range(2), "inside")
    assert spark.read.parquet(kept).count() == 3
    with pytest.raises(Exception):
        inside.count()
