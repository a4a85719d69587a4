"""WARC: the round trip against its SQL, chunks of any size, damage, defined cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import queries, warc

PAGES = "page_id long, url string, html string"


def by_hand(rows, least=1000):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        best = max(same) if same and len(data) >= least else None
        revisit = best is not None and page != best
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=repr)


BIG = "päge " * 400
ROWS = [
    (1, "http://a/", BIG), (2, None, BIG), (9, "http://b/", BIG), (3, "x\r\ny: z", "small"), (4, "", "small"), (5, "u", None), (6, "u", ""), (None, "n", BIG), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 90),
    (None, None, "only nulls " * 200), (None, "q", "only nulls " * 200), (8, "edge", "x" * 1000), (10, "edge", "x" * 1000), (11, "under", "y" * 999), (12, "under", "y" * 999), (13, "long", "long " * 50_000),
]


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_round_trip_by_chunks(spark, as_set, chunk):
    pages = spark.createDataFrame([r for r in ROWS if chunk > 7 or r[0] != 13], PAGES)
    assert as_set(warc.round_trip(pages, chunk)) == by_hand([r for r in ROWS if chunk > 7 or r[0] != 13])


def test_query_against_sql(spark, sf_dir, same_rows):
    same_rows(queries.op4_warc_chunks(spark, sf_dir), warc.SQL, sf_dir)


def test_chunks_are_the_record(spark):
    rows = warc.record_table(spark.createDataFrame([(1, "http://a/", BIG)], PAGES), 100).orderBy("chunk_no").collect()
    whole = b"".join(bytes(r["data"]) for r in rows)
    head, _, rest = whole.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response")
    length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
    assert rest[:length].endswith(BIG.encode())
    assert rest[length:] == b"\r\n\r\n"
    assert [r["chunk_no"] for r in rows] == list(range(rows[0]["n_chunks"]))
    assert rows[-1]["running_digest"] == hashlib.sha1(BIG.encode()).hexdigest()
    assert rows[0]["running_digest"] == hashlib.sha1(BIG.encode()[:100]).hexdigest()


def test_damage_is_found(spark):
    records = warc.record_table(spark.createDataFrame([(1, "http://a/", BIG)], PAGES), 500)
    bad = records.withColumn("data", F.when(F.col("chunk_no") == 2, F.expr("overlay(data PLACING X'00' FROM 9)")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(bad).collect()


def test_defined_cases(spark, clashing, as_set):
    pages = spark.createDataFrame(ROWS, PAGES)
    assert as_set(warc.round_trip(clashing(pages))) == by_hand(ROWS)
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert as_set(warc.round_trip(pages.repartition(6))) == by_hand(ROWS)


def test_a_payload_that_many_share_is_salted(spark):
    """More salts for more copies; the records are as without salts."""
    shared = spark.createDataFrame([("a", 2_000, 60_000), ("b", 2_000, 150), ("c", 2_000, 90)], "digest string, size long, c long")
    assert {r["digest"]: r["salts"] for r in warc.salted(shared).collect()} == {"a": 600, "b": 2}
    assert warc.salted(shared.limit(0)).count() == 0
    pages = spark.range(700).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 10 < 6 THEN repeat('hot ', 500) ELSE repeat(concat('p', id % 100, ' '), 400) END AS html")
    rows = warc.round_trip(pages).collect()
    best = {}
    for r in pages.collect():
        best[r["html"]] = max(best.get(r["html"], -1), r["page_id"])
    want = {r["page_id"]: None if best[r["html"]] == r["page_id"] else best[r["html"]] for r in pages.collect()}
    assert {r["page_id"]: r["refers_to"] for r in rows} == want
    assert len(rows) == 700
