"""Prefix tries of conversations: what turns their beginnings share, and how much a cache of prefixes would save.

A prefix is known by its depth and a 128-bit number that is the exclusive or of its turns' hashes, each salted with its
place. Prefixes whose subtrees hold many rows are the upper levels; below them each subtree is a shard of bounded size,
and every task builds the succinct trie of its shards: nodes in level order, a LOUDS bitvector (a one for each child of
a node, then a zero) and arrays of labels. Rollups run over it from the deepest level up. The upper levels are added up
apart: each node's value counts at one conversation that passes through it, so a subtree's sum is that of what its
conversations hold from its depth on, and no level waits for another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators import ordered

from . import workspace

#: Rows of a shard at most: a prefix whose subtree has more is of the upper levels.
SHARD_ROWS = 512
#: Rows of shards that a task builds one trie of, about.
FOREST_ROWS = 1 << 17
#: Turns of a conversation that one window runs over.
CHUNK = 1 << 16
#: Rows of prefixes that are broadcast at most (24 bytes each).
BROADCAST_ROWS = 500_000
#: Conversation numbers of one piece of a list that is digested.
PIECE = 1 << 14

#: Fixed values of the grafts: a conversation begins as the first of its so many does, for fewer than so many turns.
FAMILY, MOST = 5, 9


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), k1, k2 (hashes of role and text) and n_bytes of the text of each row, in the order of turn,
    null first; equal turns are in the order of role and text. Null role and text are empty; rows with a null conv_id
    are in no conversation."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    hashed = rows.withColumns(
        {
            "k1": F.xxhash64("role", "text"),
            "k2": F.xxhash64("text", "role", F.lit("second")),
            "n_bytes": F.octet_length("text").cast("long"),
        }
    )
    order = F.col("turn").asc_nulls_first(), "role", "text"
    return ordered.numbered(hashed, order, ["conv_id"], into="i", keep=["conv_id", "k1", "k2", "n_bytes"])


def grafted(own: DataFrame, family: int = FAMILY, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """own (see turns()), rebuilt: each conversation c begins with the first h turns of c - c % family, all if it has
    fewer and none if it is not there, and goes on with its own turns after its first h; h = crc32(c) % most.

    Gives rows (conv_id, d, k1, k2, n_bytes, total) and conversations (conv_id, total), those without turns too. The
    remainder is never negative."""
    own = workspace.stage(own, "turns")
    sizes = workspace.stage(own.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("base")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("h")
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = sizes.select("conv_id", "n", base, h).join(first, "base", "left")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    total = taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    known = workspace.stage(known.select("conv_id", "base", "h", taken.alias("taken"), total.alias("total")), "conversations")
    columns = "conv_id", "d", "k1", "k2", "n_bytes", "total"
    after = own.join(known, "conv_id").filter(F.col("i") > F.col("h")).withColumn("d", F.col("i") - F.col("h") + F.col("taken"))
    heads = own.filter((F.col("i") < most) & (F.pmod("conv_id", F.lit(family)) == 0)).withColumnRenamed("conv_id", "base")
    begin = heads.join(known, "base").filter(F.col("i") <= F.col("taken")).withColumn("d", F.col("i"))
    return after.select(*columns).unionByName(begin.select(*columns)), known.select("conv_id", "total")


def _chunk(d: str = "d"):
    return F.floor((F.col(d) - 1) / CHUNK).alias("chunk")


def _across(df: DataFrame, values: dict[str, str], how, back: bool) -> DataFrame:
    """df (conv_id, chunk, ...) with each of values, totals so far inside a chunk, joined with those of the chunks before
    it (after it, with back). Conversations of one chunk have none."""
    several = df.groupBy("conv_id", "chunk").agg(*(how(v).alias(v) for v in values.values()))
    line = Window.partitionBy("conv_id").orderBy(F.col("chunk").desc() if back else "chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = several.select("conv_id", "chunk", *(how(v).over(line).alias(f"{k}_carried") for k, v in values.items()))
    return df.join(carried, ["conv_id", "chunk"])


def paths(rows: DataFrame) -> DataFrame:
    """rows with chunk, t1, t2 (the turn's salted hashes) and p1, p2, the number of the prefix that ends with the turn."""
    rows = rows.select(
        "conv_id", "d", "n_bytes", "total", _chunk(),
        F.xxhash64("k1", "d").alias("t1"), F.xxhash64("k2", "d", F.lit("second")).alias("t2"),
    )
    line = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({"p1": F.bit_xor("t1").over(line), "p2": F.bit_xor("t2").over(line)})
    long = rows.filter("chunk > 0").limit(1)
    if long.isEmpty():
        return inside
    both = _across(workspace.stage(inside, "chunks"), {"p1": "t1", "p2": "t2"}, F.bit_xor, back=False)
    whole = {p: F.col(p).bitwiseXOR(F.coalesce(f"{p}_carried", F.lit(0))) for p in ("p1", "p2")}
    return both.withColumns(whole).drop("p1_carried", "p2_carried")


class Louds:
    """A trie in level order. bits: of each node a one for each child, then a zero, after a one and a zero for a node
    above the top; label1, label2: the turn that leads to each node; levels: where each level's nodes begin and, at last,
    end."""

    def __init__(self, children: np.ndarray, label1: np.ndarray, label2: np.ndarray, levels: list[int]):
        ends = children.cumsum() + np.arange(len(children)) + 2  # of each node's zero
        self.bits = np.ones(2 * len(children) + 1, bool)
        self.bits[1] = False
        self.bits[ends] = False
        self.label1, self.label2, self.levels = label1, label2, levels

    def parents(self) -> np.ndarray:
        """Of each node: as many zeros as there are before its one, but for the first; -1 for the top."""
        return (~self.bits).cumsum()[np.flatnonzero(self.bits)] - 1

    def children(self) -> np.ndarray:
        """Of each node: the ones between two zeros."""
        return np.diff(np.flatnonzero(~self.bits)) - 1


def build(shard: np.ndarray, depth: np.ndarray, conv: np.ndarray, label1: np.ndarray, label2: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The trie of the paths of conv, numbers from 0, and the node of each row. A row leads from the node of its
    conversation one level up, of its shard at depth 1, to a node of its own; equal labels under a node are one."""
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
    shards = int(shard.max(initial=-1)) + 1
    at = shard_of(conv, shard) + 1  # node 0 is above the shards
    node = np.zeros(len(depth), np.int64)
    levels, kids, labels1, labels2 = [0, 1], [np.array([shards])], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    levels.append(1 + shards)
    labels1.append(np.zeros(shards, np.int64))
    labels2.append(np.zeros(shards, np.int64))
    for a, b in zip(cuts[:-1], cuts[1:]):
        rows = order[a:b]
        up, one, two = at[conv[rows]], label1[rows], label2[rows]
        ranked = np.lexsort((two, one, up))
        up, one, two = up[ranked], one[ranked], two[ranked]
        new = np.ones(len(rows), bool)
        new[1:] = (up[1:] != up[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        number = levels[-1] + new.cumsum() - 1
        node[rows[ranked]] = number
        at[conv[rows[ranked]]] = number
        kids.append(np.bincount(up[new] - levels[-2], minlength=levels[-1] - levels[-2]))
        labels1.append(one[new])
        labels2.append(two[new])
        levels.append(levels[-1] + int(new.sum()))
    kids.append(np.zeros(levels[-1] - levels[-2], np.int64))
    return Louds(np.concatenate(kids), np.concatenate(labels1), np.concatenate(labels2), levels), node


def shard_of(conv: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """The shard of each conversation."""
    of = np.zeros(int(conv.max(initial=-1)) + 1, np.int64)
    of[conv] = shard
    return of


def digest(numbers) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


NODE = "d long, q1 long, q2 long, top boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _rollup(c: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The nodes of a forest of whole shards: rows (s1, s2: the shard; conv_id, d, p1, p2, t1, t2, n_bytes, total)."""
    new = np.ones(len(c["d"]), bool)
    new[1:] = (c["s1"][1:] != c["s1"][:-1]) | (c["s2"][1:] != c["s2"][:-1]) | (c["d0"][1:] != c["d0"][:-1])
    shard = new.cumsum() - 1
    ids, conv = np.unique(c["conv_id"], return_inverse=True)
    trie, node = build(shard, c["d"] - c["d0"] + 1, conv, c["t1"], c["t2"])
    parents, children, n = trie.parents(), trie.children(), trie.levels[-1]
    row = np.zeros(n, np.int64)  # any row of each node: what it says of the node is the same in all
    row[node] = np.arange(len(node))
    ends = np.flatnonzero(c["d"] == c["total"])
    n_convs, first = np.bincount(node[ends], minlength=n), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(first, node[ends], c["conv_id"][ends])
    leaves, saved = (children == 0).astype(np.int64), np.zeros(n, np.int64)
    for lo, hi in zip(trie.levels[-2:1:-1], trie.levels[:2:-1]):
        own = slice(lo, hi)
        saved[own] += (n_convs[own] - 1) * c["n_bytes"][row[own]]
        up = parents[own]
        np.add.at(n_convs, up, n_convs[own])
        np.minimum.at(first, up, first[own])
        np.add.at(leaves, up, leaves[own])
        np.add.at(saved, up, saved[own])
    low = trie.levels[2]  # above are the shards' own parents
    rest = np.arange(low, n)
    ended = ends[np.lexsort((c["conv_id"][ends], node[ends]))]
    at, starts = np.unique(node[ended], return_index=True)
    sums = np.full(n, digest(()), object)
    for k, a, b in zip(at, starts, [*starts[1:], len(ended)]):
        sums[k] = digest(c["conv_id"][ended[a:b]].tolist())
    top = parents[rest] < low
    r = row[rest]
    cols = [c["d"][r], c["p1"][r] ^ c["t1"][r], c["p2"][r] ^ c["t2"][r], top, first[rest]]
    cols = [*map(pa.array, cols), pa.array(first[parents[rest]], mask=top), *map(pa.array, (n_convs[rest], children[rest], leaves[rest], saved[rest])), pa.array(sums[rest], pa.string())]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in NODE.split(", ")])


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; tries are built of whole shards."""
    held: list[dict[str, np.ndarray]] = []

    def joined() -> dict[str, np.ndarray]:
        return {k: np.concatenate([x[k] for x in held]) for k in held[0]}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({k: batch.column(k).to_numpy() for k in batch.schema.names})
        if sum(len(x["d"]) for x in held) >= FOREST_ROWS:
            c = joined()
            last = (c["s1"] == c["s1"][-1]) & (c["s2"] == c["s2"][-1]) & (c["d0"] == c["d0"][-1])
            if not last.all():
                yield _rollup({k: v[~last] for k, v in c.items()})
            held = [{k: v[last] for k, v in c.items()}]
    if held:
        yield _rollup(joined())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, p1, p2, conv_id) come sorted: lists of the ids of a prefix, comma-joined, of PIECE ids or fewer."""
    for whole in batches:
        for at in range(0, whole.num_rows, PIECE):
            c = {k: whole.column(k).to_numpy()[at : at + PIECE] for k in whole.schema.names}
            new = np.ones(len(c["d"]), bool)
            new[1:] = (c["d"][1:] != c["d"][:-1]) | (c["p1"][1:] != c["p1"][:-1]) | (c["p2"][1:] != c["p2"][:-1])
            a = np.flatnonzero(new)
            texts = [",".join(map(str, x.tolist())) for x in np.split(c["conv_id"], a[1:])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[k][a]) for k in ("d", "p1", "p2", "conv_id")), pa.array(texts, pa.string())], ["d", "p1", "p2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces come sorted by prefix and first id: the digest of each prefix's whole list, fed piece by piece."""
    now, sha, out = None, None, []
    for batch in batches:
        for *key, ids in zip(*(batch.column(k).to_pylist() for k in ("d", "p1", "p2", "ids"))):
            if key != now:
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if now:
        out.append((*now, sha.hexdigest()))
    cols = list(zip(*out)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())], ["d", "p1", "p2", "ends_sha256"])


PREFIX = ["d", "p1", "p2"]


def _ends(ended: DataFrame) -> DataFrame:
    """The digest of the conversations that end at each prefix (d, p1, p2, conv_id). A digest must see its list in order,
    so a prefix's pieces go to one task, which holds one of them at a time."""
    dealt = ended.repartitionByRange(*PREFIX, "conv_id").sortWithinPartitions(*PREFIX, "conv_id")
    pieces = dealt.mapInArrow(_pieces, "d long, p1 long, p2 long, first long, ids string")
    fed = pieces.repartition(*PREFIX).sortWithinPartitions(*PREFIX, "first")
    return fed.mapInArrow(_digests, "d long, p1 long, p2 long, ends_sha256 string")


def _few(staged: DataFrame) -> DataFrame:
    return F.broadcast(staged) if staged.count() <= BROADCAST_ROWS else staged


def nodes(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, total; those with a total of 0 have no rows) whose turns are rows
    (conv_id, d from 1 to total, k1, k2, n_bytes, total): conv_id (smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Without conversations there is no node, not even
    the root."""
    spark = rows.sparkSession
    workspace.small_batches(spark)
    conversations = workspace.stage(conversations, "conversations")
    every = conversations.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    out = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    if not every.n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    held = workspace.stage(paths(rows), "paths")
    heavy = held.groupBy(*PREFIX).agg(F.sum(F.col("total") - F.col("d") + 1).alias("below")).filter(F.col("below") > SHARD_ROWS)
    heavy = workspace.stage(heavy.select(*PREFIX), "heavy")
    upper = workspace.stage(held.join(_few(heavy), PREFIX), "upper")
    # below its last heavy prefix each conversation is in the shard that its next one names
    cuts = workspace.stage(upper.groupBy("conv_id").agg(F.max("d").alias("cut")), "cuts")
    next_one = held.join(_few(cuts), "conv_id", "left").filter(F.col("d") == F.coalesce("cut", F.lit(0)) + 1)
    named = workspace.stage(next_one.select("conv_id", F.col("d").alias("d0"), F.col("p1").alias("s1"), F.col("p2").alias("s2")), "shards")
    light = held.drop("chunk").join(named, "conv_id").filter(F.col("d") >= F.col("d0"))
    dealt = light.repartition("s1", "s2").sortWithinPartitions("d0", "s1", "s2")
    lower = workspace.stage(dealt.mapInArrow(_forests, NODE), "lower")
    tops = lower.filter("top")

    shape = upper.groupBy(*PREFIX).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("n_bytes").alias("n_bytes"),
        F.min("t1").bitwiseXOR(F.col("p1")).alias("q1"), F.min("t2").bitwiseXOR(F.col("p2")).alias("q2"),
    )
    root = spark.createDataFrame([(0, 0, 0, every.n, every.least, 0, None, None)], "d long, p1 long, p2 long, n_convs long, conv_id long, n_bytes long, q1 long, q2 long")
    shape = workspace.stage(shape.select(*root.columns).unionByName(root), "upper-nodes")
    above = lambda df: df.select((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    kids = above(shape.filter("d > 0")).unionByName(above(tops)).groupBy(*PREFIX).agg(F.count("*").alias("n_children"))
    shape = workspace.stage(shape.join(kids, PREFIX, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "upper-nodes")

    own = (F.col("n_convs") - 1) * F.col("n_bytes")
    values = shape.select("conv_id", "d", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), F.when(F.col("d") > 0, own).otherwise(0).cast("long").alias("saved"))
    values = values.unionByName(tops.select("conv_id", "d", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    values = workspace.stage(values.groupBy("conv_id", "d").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "values")
    total = values.agg(F.sum("leaves"), F.sum("saved")).first()
    holders = values.filter("leaves <> 0 OR saved <> 0").select("conv_id").distinct()
    passed = upper.join(holders, "conv_id", "left_semi").select("conv_id", "d", "p1", "p2", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    events = passed.unionByName(values.filter("d > 0"), allowMissingColumns=True).withColumn("chunk", _chunk())
    line = Window.partitionBy("conv_id", "chunk").orderBy(F.col("d").desc()).rangeBetween(Window.unboundedPreceding, 0)
    inside = events.withColumns({"leaves_from": F.sum("leaves").over(line), "saved_from": F.sum("saved").over(line)})
    whole = _across(workspace.stage(inside, "events"), {"leaves": "leaves", "saved": "saved"}, F.sum, back=True).filter("p1 IS NOT NULL")
    rolled = whole.groupBy(*PREFIX).agg(
        F.sum(F.col("leaves_from") + F.coalesce("leaves_carried", F.lit(0))).alias("n_leaves"),
        F.sum(F.col("saved_from") + F.coalesce("saved_carried", F.lit(0))).alias("saved_tokens"),
    )
    sums = spark.createDataFrame([(0, 0, 0, *total)], "d long, p1 long, p2 long, n_leaves long, saved_tokens long")
    ended = upper.filter(F.col("d") == F.col("total")).select(*PREFIX, "conv_id")
    none = F.lit(0).cast("long")
    ended = ended.unionByName(conversations.filter("total = 0").select(none.alias("d"), none.alias("p1"), none.alias("p2"), "conv_id"))
    full = shape.join(rolled.unionByName(sums), PREFIX).join(_ends(ended), PREFIX, "left")
    full = workspace.stage(full.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(digest(())))), "upper-full")

    # the parents of both the upper nodes and the shards' tops are upper nodes; most are the root
    names = workspace.stage(shape.filter("d > 0").select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent")), "parents")
    named_by = F.when(F.col("d") == 1, F.lit(every.least)).otherwise(F.col("parent"))
    shown = lambda df: df.withColumnRenamed("d", "depth").select(*out)
    with_parent = lambda df: df.join(_few(names), ["d", "q1", "q2"], "left").withColumn("parent_conv_id", named_by)
    return shown(with_parent(full)).unionByName(shown(with_parent(tops.drop("parent_conv_id")))).unionByName(shown(lower.filter("NOT top")))


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """nodes() of conversations (conv_id, turn, role, text) rebuilt by grafted(). Further columns are left out."""
    return nodes(*grafted(turns(conversations)))
