"""Pseudonyms: valid in their format, one to one, undone by the key, linked across documents."""

import re
from datetime import date

from pyspark.sql import functions as F

from plumbline.llm import pii

SECRET = "k1"


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def run(spark, texts, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r for r in pii.pseudonymise(df, SECRET, **more).orderBy("doc_id").collect()]


TEXTS = [
    "call +1 (988) 555-2485 now", "call +1 (988) 555-2485.", "ip 42.144.35.254. and 300.1.1.1 and 1.2.3.4.5", "card 4111111111111111",
    "card 4111-1111-1111-1111 12, bad 4111111111111112", "on 2024-02-29 and 2023-02-29 or 29/02/2024", "ssn 123-45-6789 and 666-45-6789",
    "mail Bob.42@mail8.example.com.", None, "", "no numbers", "4.0. 2.0. 12", "x" * 50_000 + " 42.144.35.254 " * 300, "+1 (988) 555-2485",
]


def test_formats(spark):
    got = [r.text for r in run(spark, TEXTS)]
    assert got[8] is None and got[9:12] == TEXTS[9:12]
    phone = re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", got[0]).group()
    assert phone in got[1] and got[13] == phone and "988" not in got[0][:12]
    ip = re.search(r"ip ([\d.]+?)\. and 300.1.1.1 and 1.2.3.4.5$", got[2]).group(1)
    assert all(0 <= int(x) <= 255 for x in ip.split(".")) and got[12].count(ip) == 300 and "42.144.35.254" not in got[12]
    assert luhn(got[3]) and got[3] != TEXTS[3] and got[3].startswith("card 4")
    card, bad = got[4].split(" 12, bad ")
    assert re.fullmatch(r"card \d{4}-\d{4}-\d{4}-\d{4}", card) and luhn(card) and bad == "4111111111111112"
    assert re.sub(r"\D", "", card) == re.sub(r"\D", "", got[3])
    a, b, c = re.fullmatch(r"on (\S+) and (\S+) or (\S+)", got[5]).groups()
    assert b == "2023-02-29" and date.fromisoformat(a) == date(*map(int, c.split("/")[::-1]))
    assert re.fullmatch(r"ssn (?!123-45-6789)\d{3}-\d\d-\d{4} and 666-45-6789", got[6])
    assert re.fullmatch(r"mail user-[0-9a-f]{16}@example.invalid\.", got[7])


def test_undone_and_counted(spark):
    out = run(spark, TEXTS)
    back = run(spark, [r.text for r in out], undo=True)
    assert [r.text for r in back if "mail" not in (r.text or "")] == [t for t in TEXTS if "mail" not in (t or "")]
    assert out[5].pii == {"date": 2} and out[12].pii == {"ip": 300} and out[8].pii == {} and out[4].pii == {"card": 1}
    plain = run(spark, TEXTS, counts=None)
    assert [r.text for r in plain] == [r.text for r in out]


def test_permutation(spark):
    pairs = spark.range(7 * 11).select(F.floor(F.col("id") / 11).alias("l"), (F.col("id") % 11).alias("r"))
    f = lambda c, undo: pii.feistel(c["l"], c["r"], F.lit(7), F.lit(11), pii.Key("x"), "t", undo)
    moved = pairs.withColumn("new", f({"l": F.col("l"), "r": F.col("r")}, False)).withColumn("back", f(F.col("new"), True)).collect()
    assert len({tuple(r.new) for r in moved}) == 77 and all(tuple(r.back) == (r.l, r.r) for r in moved)
    assert sum(tuple(r.new) == (r.l, r.r) for r in moved) < 10


def test_rows(spark):
    df = spark.createDataFrame([(None, "1.2.3.4", "a"), (None, "1.2.3.4", "a")], "doc_id int, text string, pii string")
    out = pii.pseudonymise(df, SECRET).collect()
    assert out[0] == out[1] and out[0].text != "1.2.3.4"
    assert pii.pseudonymise(df.limit(0), SECRET).collect() == []
