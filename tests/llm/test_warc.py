import hashlib
import time

import pytest

from sylvan.llm import warc
from sylvan.llm.warc import MAGIC, read_warc, warc_round_trip, write_warc

PAGES = "page_id bigint, url string, html string, _sha string"


def expected(rows):
    best = {}
    for i, _, h, _ in rows:
        h = (h or "").encode()
        if len(h) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h, _ in rows:
        h = (h or "").encode()
        refers = best.get(h) if best.get(h) != i else None
        out.append((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=repr)


EVIL = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
ROWS = [
    (1, "http://a/\r\nX: y", "é" * 600, "x"), (2, None, "é" * 600, "x"), (3, "u", "é" * 499, "x"), (4, "u", "é" * 499, "x"), (5, "u", None, "x"), (6, "u", "", "x"),
    (None, "u", "z" * 1500, "x"), (7, "u", "z" * 1500, "x"), (7, "u", "z" * 1500, "x"), (None, "u", "only null" * 200, "x"), (None, "u", "only null" * 200, "x"),
    (8, "u", EVIL * 40, "x"), (9, "u", "WARC/1.0\r\n", "x"), (10, "u", "WA" + EVIL + "\r\n\r\n" * 3, "x"), (11, "u", "q" * 200_000 + EVIL, "x"), (12, "u", (EVIL + "w" * 3000) * 20, "x"),
]


def test_round_trip_with_magic_in_payloads(spark):
    out = warc_round_trip(spark.createDataFrame(ROWS, PAGES))
    assert rows_of(out) == expected(ROWS)
    assert all(r.digest_ok for r in out.collect())


@pytest.mark.parametrize("piece", [1000, 4096])
def test_pieces_smaller_than_records(spark, tmp_path, piece):
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame(ROWS, PAGES).coalesce(1), path)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(piece))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        out = read_warc(spark, path).withColumnRenamed("type", "record_type")
        assert rows_of(out) == expected(ROWS)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


FAKE = MAGIC + "WARC-Type: response\r\nContent-Length: 99999999999\r\n\r\n"


def test_fake_heads_cost_linear_time():
    seconds = []
    for heads in (2_500, 10_000):
        piece = warc._Piece("p", 0)
        payload = (FAKE + "x" * 500) * heads
        value = f"WARC/1.0\r\nContent-Length: {len(payload)}\r\n\r\n{payload}\r\n\r\n"
        start = time.process_time()
        for x in value.split(MAGIC):
            piece.segment(x.encode())
        rows = piece.rows()
        seconds.append(time.process_time() - start)
        first = rows[rows["at"] == 0].iloc[0]
        assert first.complete and first.digest == hashlib.sha1(payload.encode()).hexdigest() and len(rows) == heads + 2
    assert seconds[1] < 12 * seconds[0] + 0.5


@pytest.mark.parametrize("piece", [3000, 1 << 20])
def test_fake_heads_and_torn_records(spark, tmp_path, monkeypatch, piece):
    """Records over many pieces, and records that no task hashed, are hashed when the chain is known."""
    monkeypatch.setattr(warc, "HASHED", 0)
    monkeypatch.setattr(warc, "SLACK", 0)
    rows = [(i, "u", (FAKE + "y" * (50 * i)) * 30, "x") for i in range(1, 12)] + [(50, "u", EVIL * 10, "x")]
    path = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame(rows, PAGES).coalesce(2), path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    keep = {k: spark.conf.get(k) for k in names}
    try:
        spark.conf.set(names[0], str(piece))
        spark.conf.set(names[1], "1")
        assert rows_of(read_warc(spark, path).withColumnRenamed("type", "record_type")) == expected(rows)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_empty(spark):
    assert warc_round_trip(spark.createDataFrame([], PAGES)).collect() == []
