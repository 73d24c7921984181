"""Every registered query against its SQL twin in DuckDB, over the whole small tables."""

import math
import sys
from collections import Counter
from datetime import datetime, timezone
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402

FOLDER = Path(entry.SMALL)
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime):
        return (v if v.tzinfo is None else v.astimezone(timezone.utc)).replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert len(columns) == len(set(columns))
        return
    result = duck.execute(SQL[name])
    there = [d[0] for d in result.description]
    assert sorted(there) == columns
    at = [there.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["run_id", "page_id", "change_type"]


def test_no_sql_without_a_query():
    assert set(SQL) <= set(QUERIES)
