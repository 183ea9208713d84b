"""The trie of rebuilt conversations against plain Python, with shards and chunks of a few rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import prefix_trie, queries


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - c % 5, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def brute(rows):
    convs = rebuilt(rows)
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        last = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[k] for k in kids[node])
    sha = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    return sorted(
        ((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n], sha(ends[n])) for n, m in members.items()),
        key=str,
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def made(seed=1, n=90):
    """Short conversations over few turns, copies of one, one long, one of a hot id, ties, nulls and missing bases."""
    rng = random.Random(seed)
    text = lambda: rng.choice(["", None, "héllo", "a b", "yes", "日本"])
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        rows += [(c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), text()) for t in range(rng.randint(1, 12))]
    rows += [(1000 + k, t, "user", f"copy {t}") for k in range(60) for t in range(14)]
    rows += [(2000, t, "user", str(t // 2)) for t in range(70)] + [(2001, t, "user", str(t // 2)) for t in range(75)]
    rows += [(3001, 1, "user", "alone")] * 5 + [(None, 1, "user", "no id"), (10**12 + 4, 0, "user", "x")]
    rng.shuffle(rows)
    return rows


def test_query_over_the_smallest_tables(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
        assert found(queries.op13_prefix_trie(spark, f"/root/testdata/{sf}")) == brute(map(tuple, rows))


@pytest.mark.parametrize("shard,chunk,forest", [(512, 1 << 16, 1 << 17), (20, 7, 30), (3, 1000, 10), (0, 5, 1)])
def test_shards_chunks_and_odd_rows(spark, monkeypatch, shard, chunk, forest):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "FOREST_ROWS", forest)
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = made()
        df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, d long, k1 string").repartition(5)
        assert found(prefix_trie.prefix_nodes(df)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_louds_of_a_known_tree():
    """A top with children 1, 2; 1 has 3, 4, 5; 2 has none; 4 has 6."""
    trie = prefix_trie.Louds(np.array([2, 3, 0, 0, 1, 0, 0]), np.zeros(7), np.zeros(7), [0, 1, 3, 6, 7])
    assert "".join(map(str, trie.bits.astype(int))) == "10" + "110" + "1110" + "0" + "0" + "10" + "0" + "0"
    assert trie.parents().tolist() == [-1, 0, 0, 1, 1, 1, 4]
    assert trie.children().tolist() == [2, 3, 0, 0, 1, 0, 0]


def test_turnless_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "gone")]  # its base is not there, its own first turns go
    assert brute(rows) == found(prefix_trie.prefix_nodes(spark.createDataFrame(rows, schema)))
    assert brute(rows)[0][1:7] == (0, None, 1, 0, 1, 0)
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], schema)).collect() == []
