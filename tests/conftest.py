"""Session, small graphs, and the comparison with DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from weftgraph.graph import PropertyGraph  # noqa: E402

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.range(0).count()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(DATA / "sf0.001")


@pytest.fixture
def trio(spark):
    """Ada -> Bo -> Cy; ``rank`` is a number on nodes and text on edges."""
    g = PropertyGraph.empty(spark)
    ada, bo, cy = g.bulk_add_node([{"rank": 1, "age": 20, "name": "Ada", "note": "only here"}, {"rank": 1, "age": 30, "name": "Bo"}, {"rank": 2, "age": 30, "name": "Cy"}])
    g.bulk_add_edge([(ada, bo, {"label": "likes", "year": 1901, "town": "oslo", "rank": "HiGh"}), (bo, cy, {"label": "helps", "year": 1907, "town": "Oslo", "rank": "igloo"})])
    return g


@pytest.fixture
def shop(spark):
    """Books 0 to 5; readers 6 to 9, who bought books, but for the last, who only saw one."""
    g = PropertyGraph.empty(spark)
    g.bulk_add_node([{"kind": "book"}] * 6 + [{"kind": "reader"}] * 4)
    bought = {6: (0, 2, 3), 7: (1, 4), 8: (0, 2, 4, 5)}
    g.bulk_add_edge_by_ids([(reader, book, {"action": "bought"}) for reader, books in bought.items() for book in books] + [(9, 0, {"action": "saw"})])
    return g


def plain(v):
    """Values that Spark and DuckDB give in different classes."""
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    got = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(got, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if (p := Path(sf_dir) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Fails unless a frame and a query have the same columns and rows."""

    def check(df, sql, sf_dir):
        found = duck(sf_dir).execute(sql)
        want = rows_of([d[0] for d in found.description], found.fetchall())
        got = rows_of(df.columns, df.collect())
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        assert got[1] == want[1]

    return check
