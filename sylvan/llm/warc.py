"""WARC archives: a writer with revisit records, and a reader that trusts only the chain of record boundaries.

Writing: one record for each page, the HTML as payload behind HTTP headers. Of records with equal payloads of at least
revisit_bytes, that with the largest page_id is a response, the others revisit it (headers only, WARC-Refers-To). Spark's
text writer puts the records down, so archives can go to any store that Spark can write.

Reading: tasks read pieces of the archives, cut at every "WARC/1.0" line, payloads included. Each cut is a candidate record;
its header gives its successor's offset. A task follows successors inside its piece, so that each candidate points to where
its chain leaves the piece; pointer jumping over these exits, from the start of each file, then finds where the true chain
enters every piece, and a walk inside the pieces retains the reachable records. Magic inside a payload is on no chain from
the start and goes.

Cases: null HTML is an empty payload; a null page_id is left out of the header and null when read; of equal payloads
without any page_id all are responses; rows that repeat the largest page_id all are responses; line breaks in a URL are
percent-encoded; a very long payload is hashed as it streams by, and heads inside of it cost time in proportion to its length; an
empty table writes no records and reads back none. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylvan.runtime import join_per_key, materialize, shared_path

from .common import broadcast_if_few

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: WARC-Profile of a revisit to an identical payload, as the format's specification has it.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A task hashes HASHED times the bytes that it reads at most (and SLACK more), so that heads inside payloads which claim
#: ever more bytes cost no more than that; records that are left are hashed when the chain is known.
HASHED, SLACK = 4, 1 << 20
KEPT = (
    "path string, block bigint, at bigint, next bigint, type string, page_id bigint, refers_to bigint, "
    "header_digest string, payload_bytes bigint, digest string, complete boolean"
)
FOUND = KEPT + ", exit bigint, total bigint"


def with_revisits(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, _n (bytes), _sha and _refers (null: a response) of each page."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.coalesce(F.col("url"), F.lit("")).alias("url")
    size, sha = F.octet_length(html).cast("bigint").alias("_n"), F.sha1(html).alias("_sha")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), url, html.alias("html"), size, sha)
    large = rows.where(F.col("_n") >= revisit_bytes).groupBy("_sha").agg(F.max("page_id").alias("_keeps"), F.count("*").alias("_copies"))
    large = materialize(large.where(F.col("_copies") > 1), "payloads")
    both = join_per_key(rows, large, ["_sha"], "_copies", rows.count(), ["page_id", "url"], "left")
    refers = F.when((F.col("_n") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("_keeps")), F.col("_keeps"))
    return both.select("page_id", "url", "html", "_n", "_sha", refers.alias("_refers"))


def _record(date: str) -> Column:
    revisit = F.col("_refers").isNotNull()
    status = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ")
    http = F.concat(status, F.col("_n").cast("string"), F.lit(END))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_n"))
    return F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Record-ID: "), page("page_id")), F.lit("")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Refers-To: "), page("_refers"), F.lit("\r\nWARC-Profile: " + PROFILE)), F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("_sha"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END),
        http, F.when(revisit, "").otherwise(F.col("html")),
    )


def write_warc(pages: DataFrame, path: str, revisit_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as uncompressed WARC archives below path."""
    with_revisits(pages, revisit_bytes).select(_record(date).alias("value")).write.option("lineSep", END).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def _number(value: bytes | None) -> int | None:
    m = re.search(rb"(-?\d+)>?$", value or b"")
    return int(m[1]) if m else None


class _Piece:
    """What a task finds in one piece of a file. Offsets are relative to the first cut in the piece."""

    def __init__(self, path: str, block: int):
        self.path, self.block, self.end = path, block, 0
        self.found: list[dict] = []
        self.open: list[tuple[dict, object, int]] = []  # records that go on behind a cut: row, hash, bytes missing
        self.hashed = 0

    def segment(self, value: bytes) -> None:
        """value: the bytes between two cuts. The file's start is no cut, so nothing stands before its first one."""
        going, data = [], MAGIC.encode() + value
        if self.hashed > HASHED * self.end + SLACK:
            self.open = self.open[:1]  # the first may hold all others
        for row, digest, missing in self.open:
            digest.update(data[:missing])
            self.hashed += len(data)
            row["digest"] = digest.hexdigest()
            row["complete"] = missing <= len(data)
            if not row["complete"]:
                going.append((row, digest, missing - len(data)))
        self.open = going
        head = value.find(END.encode()) if self.block or self.end else -1
        fields = _fields(value[:head]) if head >= 0 else {}
        length = fields.get(b"content-length", b"")
        if length.isdigit() and len(length) < 19:
            at, start = self.end - len(MAGIC), head + len(END)
            block = value[start : start + int(length)]
            body = block.find(END.encode()) + len(END) if fields.get(b"content-type", b"").startswith(b"application/http") else 0
            payload, size = block[body:], int(length) - body
            row = {"at": at, "next": self.end + start + int(length) + len(END), "payload_bytes": size}
            row |= {"type": fields.get(b"warc-type", b"").decode("utf-8", "replace")}
            row |= {"page_id": _number(fields.get(b"warc-record-id")), "refers_to": _number(fields.get(b"warc-refers-to"))}
            row |= {"header_digest": fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")}
            row |= {"digest": hashlib.sha1(payload).hexdigest(), "complete": len(payload) == size}
            if row["type"] == "revisit":
                size = _number(_fields(block).get(b"content-length")) or 0
                row |= {"payload_bytes": size, "digest": row["header_digest"], "complete": True}
            elif not row["complete"]:
                self.open.append((row, hashlib.sha1(payload), size - len(payload)))
            self.found.append(row)
        self.end += len(value) + len(MAGIC)

    def rows(self) -> pd.DataFrame:
        """All candidates with exit: the first successor outside the piece, null if the chain breaks inside; last, the total."""
        exits: dict[int, int | None] = {}
        for row in reversed(self.found):
            to = row["next"]
            exits[row["at"]] = row["exit"] = exits.get(to) if to < self.end - len(MAGIC) else to
        out = pd.DataFrame([*self.found, {"total": self.end}], columns=[x.split()[0] for x in FOUND.split(", ")])
        numbers = ("at", "next", "exit", "total", "page_id", "refers_to", "payload_bytes")
        return out.assign(path=self.path, block=self.block).astype(dict.fromkeys(numbers, "Int64"))


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    piece = None
    for pdf in batches:
        for path, block, value in zip(pdf.path, pdf.block, pdf.value, strict=True):
            if piece is None or (piece.path, piece.block) != (path, block):
                if piece is not None:
                    yield piece.rows()
                piece = _Piece(path, block)
            piece.segment(bytes(value))
    if piece is not None:
        yield piece.rows()


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block")
    return spark.read.option("lineSep", MAGIC).text(path).select(*place, F.col("value").cast("binary").alias("value"))


def _walk(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The records of a piece that the chain from its entry reaches."""
    names = [x.split()[0] for x in KEPT.split(", ")]
    if not len(left) or not len(right):
        return pd.DataFrame(columns=names)
    following = dict(zip(left["at"].tolist(), left["next"].tolist(), strict=True))
    at, keep = int(right["at"].min()), set()
    while at in following:
        keep.add(at)
        at = following[at]
    return left[left["at"].isin(keep)][names]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """path, offset, type, page_id, refers_to, payload_bytes, payload_digest (of the payload as read; a revisit's from its header), digest_ok."""
    found = materialize(_cuts(spark, path).mapInPandas(_candidates, FOUND), "candidates")
    total = found.where(F.col("total").isNotNull())
    pieces = Window.partitionBy("path").orderBy("block")
    before = F.coalesce(F.sum("total").over(pieces.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = total.select("path", "block", before.alias("base"), "total", F.row_number().over(pieces).alias("number"))
    bases = materialize(bases, "pieces")
    most = bases.groupBy("path").count().agg(F.max("count")).first()[0] or 0
    rows = found.where(F.col("at").isNotNull()).drop("total").join(bases.select("path", "block", "base"), ["path", "block"])
    rows = rows.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "exit")}).drop("base")
    #: Nodes of the jumping: the start of each file, and where any chain leaves a piece.
    starts = bases.select("path", F.lit(0).cast("bigint").alias("at")).distinct()
    entries = rows.where("exit is not null").select("path", F.col("exit").alias("at")).union(starts).distinct()
    jump = materialize(rows.join(entries, ["path", "at"], "left_semi").select("path", "at", "block", F.col("exit").alias("to")), "jumps")
    reached = starts
    hops = jump.select("path", "at", "to")
    for _ in range(max(0, most - 1).bit_length()):
        after = reached.join(hops, ["path", "at"]).where("to is not null").select("path", F.col("to").alias("at"))
        reached = materialize(reached.union(after).distinct(), "reached")
        far = hops.select("path", F.col("at").alias("to"), F.col("to").alias("far"))
        hops = materialize(hops.join(far, ["path", "to"]).select("path", "at", F.col("far").alias("to")), "hops")
    enter = jump.join(reached, ["path", "at"], "left_semi").select("path", "block", "at")
    own = rows.select(*[x.split()[0] for x in KEPT.split(", ")]).groupBy("path", "block")
    kept = materialize(own.cogroup(enter.groupBy("path", "block")).applyInPandas(_walk, KEPT), "records")
    torn = kept.where(~F.col("complete"))
    if not torn.isEmpty():
        kept = kept.where("complete").unionByName(_mend(spark, path, torn, kept, bases))
    digest, good = F.col("digest").alias("payload_digest"), (F.col("digest") == F.col("header_digest")).alias("digest_ok")
    return kept.select("path", F.col("at").alias("offset"), "type", "page_id", "refers_to", "payload_bytes", digest, good)


def _offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, end = None, 0
    for pdf in batches:
        at = []
        for path, block, value in zip(pdf.path, pdf.block, pdf.value, strict=True):
            if last != (path, block):
                last, end = (path, block), 0
            at.append(end)
            end += len(value) + len(MAGIC)
        yield pdf.assign(at=at)


def _mend(spark: SparkSession, path: str, torn: DataFrame, kept: DataFrame, bases: DataFrame) -> DataFrame:
    """Records on the chain whose payload no task has hashed: cut by magic inside it, and going on in another piece or left out.

    A record's pieces run from its own to that of the record behind it, and the archives' bytes meet the records by (path,
    piece). Records don't overlap, so no byte is taken twice.
    """

    def glue(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return left
        row = left.iloc[0]
        digest, skip = hashlib.sha1(), int(row["next"] - row["at"] - len(END) - row.payload_bytes)
        missing = int(row.payload_bytes)
        for value in right.sort_values("cut").value:
            data = (MAGIC.encode() + bytes(value))[skip : skip + missing]
            skip = max(0, skip - len(MAGIC) - len(value))
            digest.update(data)
            missing -= len(data)
        return left.assign(digest=digest.hexdigest(), complete=missing == 0)

    number = bases.select("path", "block", "number")
    after = kept.join(number, ["path", "block"]).select("path", F.col("at").alias("next"), F.col("number").alias("until"))
    most = bases.groupBy("path").agg(F.max("number").alias("most"))
    owner = torn.select("path", "block", "at", "next").join(number, ["path", "block"]).join(after, ["path", "next"], "left").join(most, "path")
    owner = owner.withColumn("number", F.explode(F.sequence("number", F.coalesce("until", "most")))).drop("block")
    owner = owner.join(bases, ["path", "number"]).select("path", "block", "base", F.col("at").alias("start"), "next")
    owner = broadcast_if_few(materialize(owner, "owners"))
    cuts = _cuts(spark, path).mapInPandas(_offsets, "path string, block bigint, value binary, at bigint")
    parts = cuts.join(owner, ["path", "block"]).withColumn("cut", F.col("base") + F.col("at") - len(MAGIC))
    parts = parts.where("cut >= start and cut < next").select("path", F.col("start").alias("at"), "cut", "value")
    return torn.groupBy("path", "at").cogroup(parts.groupBy("path", "at")).applyInPandas(glue, torn.schema)


def warc_round_trip(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Write pages to archives in the shared folder, read these, and give a row for each record."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path, revisit_bytes)
    out = read_warc(spark, path)
    return out.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to", "digest_ok", "offset")
