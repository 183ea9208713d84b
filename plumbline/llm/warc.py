"""WARC archives: written by Spark's text writer, indexed first, then read by coalesced byte ranges.

A record is a line of the text writer whose separator is the WARC record end, so the archives are written with
Spark's commit protocol to any file system it knows. The index holds file, offset, length, URL and digest of each
record; readers select from it and fetch only runs of neighbouring ranges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import workspace

CRLF = "\r\n"
END = CRLF + CRLF
ID_PREFIX = "urn:x-page:"
HTTP_HEAD = "HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "

INDEX_SCHEMA = (
    "file string, offset long, length long, body_offset long, record_type string, url string, digest string, "
    "record_key string, refers_to string, payload_bytes long"
)


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise(F.lit(""))


def revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, digest, refers_to) of the pages whose payload of at least min_bytes another page has with a smaller
    page_id. Only ids, sizes and digests are shuffled. A null page_id comes after all others, and pages that share
    both payload and smallest page_id are all first."""
    facts = pages.select("page_id", "payload_bytes", "digest").filter(F.col("payload_bytes") >= min_bytes)
    firsts = (
        facts.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
        .filter((F.col("n") > 1) & F.col("refers_to").isNotNull())
        .drop("n")
    )
    later = facts.select("page_id", "digest").distinct().join(firsts, "digest")
    return later.filter(F.col("page_id").isNull() | (F.col("page_id") > F.col("refers_to")))


def prepare(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest; other columns are left out. A null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id"),
        F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 100,
    date: str = "2024-01-01T00:00:00Z",
    records_per_archive: int = 8000,
) -> None:
    """Writes one response or revisit record per row of pages (page_id, url, html) to archives under path.

    An archive has records_per_archive records at most, which bounds the index rows of an archive. The payload is
    not shuffled while the list of revisits is small enough to broadcast by Spark's own size limit.
    """
    ready = prepare(pages)
    known = workspace.stage(revisits(ready, min_bytes), "revisits")
    again = known.select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to")
    joined = ready.join(again, (ready.digest == again.r_digest) & ready.page_id.eqNullSafe(again.r_id), "left")
    is_revisit = F.col("refers_to").isNotNull()
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    block = F.concat(
        F.lit(HTTP_HEAD), F.col("payload_bytes"), F.lit(END), F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    )
    record = F.concat(
        F.lit("WARC/1.1" + CRLF),
        F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"), F.lit(CRLF),
        F.lit(f"WARC-Record-ID: <{ID_PREFIX}"), key, F.lit(">" + CRLF),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        _header("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(CRLF),
        F.when(is_revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
            F.lit(f"WARC-Refers-To: <{ID_PREFIX}"), F.col("refers_to").cast("string"), F.lit(">" + CRLF),
        )).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        F.lit("Content-Length: "), F.octet_length(F.col("block")), F.lit(END), F.col("block"),
    )
    lines = joined.withColumn("block", block).select(record.alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", records_per_archive).text(path)


class _Pieces:
    """A file read forward in pieces; at() gives a short stretch, since() what there is from an offset on."""

    def __init__(self, source, piece: int = 1 << 20):
        self.source, self.piece, self.size = source, piece, source.size()
        self.start, self.held = 0, b""

    def since(self, offset: int, least: int) -> memoryview:
        stop = min(self.size, offset + least)
        if offset < self.start or stop > self.start + len(self.held):
            self.source.seek(offset)
            self.start, self.held = offset, self.source.read(max(least, self.piece))
        return self.held[offset - self.start : offset - self.start + max(least, 0)]

    def head(self, offset: int) -> tuple[bytes, int]:
        """The header block that begins at offset, and the offset behind its empty line."""
        least = 2048
        while True:
            found = self.since(offset, least)
            end = found.find(END.encode())
            if end >= 0:
                return found[:end], offset + end + 4
            if offset + least >= self.size:
                raise ValueError(f"no end of the header that begins at {offset}")
            least *= 4


def parse(source) -> Iterator[dict]:
    """The records of one archive (a seekable file with size()) by their Content-Length, with the offsets of record
    and HTTP body. Payloads are skipped, so memory does not depend on the size of archive or record."""
    pieces, at = _Pieces(source), 0
    strip = lambda x: x[len(ID_PREFIX) + 1 : -1] if x else None
    while at < pieces.size:
        block_head, block = pieces.head(at)
        lines = block_head.decode("utf-8").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at offset {at}")
        head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        http, body = pieces.head(block)
        sizes = [x for x in http.decode("latin-1").split(CRLF) if x.lower().startswith("content-length:")]
        stop = block + int(head["content-length"])
        yield {
            "offset": at,
            "length": stop - at,
            "body_offset": body,
            "record_type": head["warc-type"],
            "url": head.get("warc-target-uri"),
            "digest": head["warc-payload-digest"].partition(":")[2],
            "record_key": strip(head["warc-record-id"]),
            "refers_to": strip(head.get("warc-refers-to")),
            "payload_bytes": int(sizes[0].partition(":")[2]),
        }
        at = stop + 4


def _index_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in INDEX_SCHEMA.split(", ")]
    for frame in frames:
        for path in frame["path"]:
            with _open(path) as source:
                yield pd.DataFrame([{"file": path, **r} for r in parse(source)], columns=names)


def index_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path: INDEX_SCHEMA, written to the shared folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path")
    return workspace.stage(files.mapInPandas(_index_files, INDEX_SCHEMA), "warc-index")


def coalesce_ranges(selected: DataFrame, max_gap: int = 64 << 10, run_bytes: int = 8 << 20) -> DataFrame:
    """Runs of selected records: file, start, stop and the records in them by offset. Records less than max_gap apart
    are fetched together; a run starts anew every run_bytes, so a run has run_bytes and one record at most."""
    order = Window.partitionBy("file").orderBy("offset")
    before = F.lag(F.col("offset") + F.col("length")).over(order)
    cut = F.floor(F.col("offset") / run_bytes)
    breaks = before.isNull() | (F.col("offset") - before > max_gap) | (cut != F.lag(cut).over(order))
    runs = selected.withColumn("new", breaks.cast("int")).withColumn(
        "run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    parts = F.struct("offset", "length", "body_offset", "record_key", "url", "digest")
    return (
        runs.groupBy("file", "run")
        .agg(
            F.min("offset").alias("start"),
            F.max(F.col("offset") + F.col("length")).alias("stop"),
            F.sort_array(F.collect_list(parts)).alias("records"),
        )
        .drop("run")
    )


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/"):
        path = "file:///" + path[5:].lstrip("/")
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


READ_SCHEMA = "record_key string, url string, payload binary, payload_bytes long, payload_digest string, expected string"


def _read_runs(keep_payload: bool):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start, stop, records in zip(frame["file"], frame["start"], frame["stop"], frame["records"]):
                with _open(path) as source:
                    source.seek(int(start))
                    block = source.read(int(stop - start))
                rows = []
                for r in records:
                    body = block[r["body_offset"] - start : r["offset"] + r["length"] - start]
                    rows.append((
                        r["record_key"], r["url"], body if keep_payload else None, len(body),
                        hashlib.sha256(body).hexdigest(), r["digest"],
                    ))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    return read


def read_records(selected: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The payloads of the selected index rows, fetched by coalesced byte ranges: READ_SCHEMA. payload_digest is of
    the bytes read, expected the one in the index. The archives must be in a store that pyarrow.fs opens."""
    return coalesce_ranges(selected).mapInPandas(_read_runs(keep_payload), READ_SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Writes pages to archives in the shared folder, indexes them and reads them back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and url. A response's size and digest are
    those of the bytes read; a revisit's are in its own headers. A null html counts as an empty payload, repeated
    rows make a record each, an empty table gives no rows, and further columns are ignored.
    """
    spark = pages.sparkSession
    path = workspace.new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    index = index_archives(spark, path)
    kind = dict(pages.dtypes)["page_id"]
    to_id = lambda name: F.expr(f"try_cast({name} AS {kind})")
    responses = read_records(index.filter(F.col("record_type") == "response"), keep_payload=False).select(
        to_id("record_key").alias("page_id"), "payload_bytes", "payload_digest",
        F.lit("response").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"), "url",
    )
    others = index.filter(F.col("record_type") == "revisit").select(
        to_id("record_key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        "record_type", to_id("refers_to").alias("refers_to"), "url",
    )
    return responses.unionByName(others)
