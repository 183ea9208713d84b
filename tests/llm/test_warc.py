"""Archives read back by a plain reader, ranges against whole records, and the round trip's contract."""

import hashlib
import io

from pyspark.sql import functions as F

from plumbline.llm import warc, workspace


class Sized(io.BytesIO):
    def size(self):
        return len(self.getvalue())


BIG = "é" * 80
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, "http://a/3 x\n", "short"), (4, None, "short"), (5, "u", None), (6, "u", ""),
    (7, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 9), (8, "u", "long " * 200_000), (0, "u", BIG), (9, "u", "long " * 200_000), (9, "u", "long " * 200_000), (None, "u", BIG),
]


def frame(spark):
    return spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, digest string").repartition(3)


def want():
    out, first = [], {}
    for i, _, h in ROWS:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(i, first.get(b, i))
    for i, _, h in ROWS:
        b = (h or "").encode()
        again = len(b) >= 100 and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    cols = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    got = [tuple(r) for r in warc.round_trip(frame(spark)).select(*cols).collect()]
    assert sorted(got, key=str) == want()
    assert warc.round_trip(frame(spark).limit(0)).collect() == []


def test_index_and_ranges(spark):
    path = workspace.new_path(spark, "warc-test")
    warc.write_archives(frame(spark), path, records_per_archive=3)
    index = warc.index_archives(spark, path).collect()
    assert len(index) == len(ROWS)
    contents = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(path + "/part-*").collect()}
    assert sum(r.length + 4 for r in index) == sum(map(len, contents.values()))
    for r in index:
        record = contents[r.file][r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\n") and [x["offset"] for x in warc.parse(Sized(record))] == [0]
    chosen = warc.index_archives(spark, path).filter("record_type = 'response' AND record_key IN ('0', '3', '7')")
    got = {r.record_key: bytes(r.payload).decode() for r in warc.read_records(chosen).collect()}
    assert got == {"0": BIG, "3": "short", "7": ROWS[6][2]}
    urls = {r.record_key: r.url for r in index}
    assert urls["3"] == "http://a/3%20x%20" and urls["4"] is None
    runs = warc.coalesce_ranges(warc.index_archives(spark, path)).select(F.size("records").alias("n")).collect()
    assert sum(r.n for r in runs) == len(ROWS) > len(runs)
