"""Near-duplicate texts by ProbMinHash signatures of weighted word shingles, banding and verification.

Each shingle of a text is a Poisson process whose rate is the shingle's weight; its arrivals fall on registers at
random, and a register keeps the shingle that arrived there first. A text is done as soon as no later arrival can be
first anywhere. Two texts agree on a register with the probability Jaccard similarity of their weighted shingles, whose
complement is a metric. Texts that agree on a band of registers are candidates; those that agree on too few registers
altogether to be similar go, the others are verified by the exact similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, workspace
from .tokens import NOT_WORD, U64, mix, runs, text_slices, tokenise

#: Words of a shingle; least similarity of a pair, but for rounding (1e-9).
WORDS, LEAST = 5, 0.8
#: Bands and registers of a band: a pair at 0.8 shares no band in 3 of a million cases.
BANDS, ROWS = 24, 4
#: A band's bucket with at most so many classes is compared pair by pair; in a larger one members meet hubs of so many
#: components in so many rounds, and what is in several components then is compared by rare shingles.
FEW, HUBS, ROUNDS = 16, 4, 1
#: Chance that a pair at least as similar as asked for agrees on too few registers to be verified.
MISS = 1e-7
#: Rows of ids (28 bytes each) that are broadcast to the texts at most.
BROADCAST_ROWS = 500_000
#: Texts that are compared with one hub in one group.
CHUNK = 1000
#: Texts, about, that shingles are counted on to tell the rare ones, and slots that they are counted in. These only say
#: in which order shingles are looked at; any order gives the same pairs.
COUNTED, SLOTS = 10_000, 2**21


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of each text's distinct shingles, and a hash of each text's words in their order. A text of
    fewer than WORDS words has one shingle of all of them. The weight is 1 + ln(count)."""
    tokens = tokenise(texts, NOT_WORD)
    h, text = runs(tokens, WORDS, short=True)
    _, first, n = np.unique(mix(h + text.astype(U64) * U64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
    order = np.argsort(first, kind="stable")
    first, n = first[order], n[order]
    place = np.arange(len(tokens.words)) - tokens.offsets[tokens.text_of()]
    terms = mix(tokens.hashes + mix(place.astype(U64) + U64(1)))
    whole = np.zeros(len(texts), U64)
    np.add.at(whole, tokens.text_of(), terms)
    return text[first], h[first], 1.0 + np.log(n), mix(whole)


def signatures(text: np.ndarray, h: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """texts x m: the shingle that arrived first at each register; zeros for a text without shingles."""
    arrived, first = np.full(texts * m, np.inf), np.zeros(texts * m, U64)
    now = np.zeros(len(h))
    going = np.arange(len(h))
    step = 0
    while len(going):
        drawn = mix(h[going] ^ U64((step * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64))
        now[going] -= np.log(((drawn >> U64(11)).astype(float) + 1) * 2.0**-53) / weight[going]
        at = text[going] * m + (mix(drawn) % U64(m)).astype(np.int64)
        np.minimum.at(arrived, at, now[going])
        won = now[going] == arrived[at]
        first[at[won]] = h[going[won]]
        open_texts = np.unique(text[going])
        last = np.full(texts, -np.inf)
        last[open_texts] = arrived.reshape(texts, m)[open_texts].max(1)
        going = going[now[going] < last[text[going]]]
        step += 1
    return first.reshape(texts, m)


def bands(first: np.ndarray) -> np.ndarray:
    """texts x BANDS: a number for the shingles in each band of registers."""
    cut = first.reshape(len(first), BANDS, ROWS)
    total = np.zeros((len(first), BANDS), U64)
    for r in range(ROWS):
        total = mix(total * U64(0x9E3779B97F4A7C15) + cut[:, :, r])
    return mix(total + np.arange(BANDS, dtype=U64)).view(np.int64)


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """The sum, over common shingles i, of 1 / sum over all j of max(a_j / a_i, b_j / b_i). With the shingles in the
    order of a_j / b_j the maximum is the b-part before i and the a-part from i on. ha, hb: distinct."""
    if not len(ha) or not len(hb):
        return 0.0
    if wa.max() == 1 == wb.max():  # then it is that of the sets, as for most texts
        common = np.intersect1d(ha, hb, assume_unique=True).size
        return common / (len(ha) + len(hb) - common)
    keys = np.unique(np.concatenate([ha, hb]))
    a, b = np.zeros(len(keys)), np.zeros(len(keys))
    a[np.searchsorted(keys, ha)] = wa
    b[np.searchsorted(keys, hb)] = wb
    ratio = np.divide(a, b, out=np.full(len(keys), np.inf), where=b > 0)
    order = np.argsort(ratio, kind="stable")
    a, b = a[order], b[order]
    from_here = a[::-1].cumsum()[::-1]
    before = b.cumsum() - b
    both = (a > 0) & (b > 0)
    return float((1 / (from_here[both] / a[both] + before[both] / b[both])).sum())


def enough(least: float, registers: int = BANDS * ROWS, miss: float = MISS) -> int:
    """The registers that a pair must agree on to be verified: one with the similarity least has fewer with a chance of
    at most miss."""
    below, k = 0.0, 0
    while True:
        below += math.comb(registers, k) * least**k * (1 - least) ** (registers - k)
        if below > miss:
            return k
        k += 1


SIGNED_SCHEMA = "id long, high long, low long, bands array<long>, registers binary"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        text, h, weight, order = shingles(batch.column("text"))
        n = batch.num_rows
        total = np.zeros(n, U64)
        np.add.at(total, text, mix(h))
        first = signatures(text, h, weight, n, BANDS * ROWS)
        has = np.bincount(text, minlength=n) > 0
        ends = np.concatenate([[0], np.cumsum(has * BANDS)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands(first)[has].ravel()))
        registers = (mix(first) & U64(255)).astype(np.uint8)  # as much of a register as tells most others apart
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(order.view(np.int64)), pa.array(total.view(np.int64)), lists, pa.array([r.tobytes() for r in registers])],
            ["id", "high", "low", "bands", "registers"],
        )


def _alike(least: int):
    """The pairs that agree on at least least registers."""
    numbers = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (numbers(batch.column("registers_a")) == numbers(batch.column("registers_b"))).sum(1)
                yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    return run


def _similar(least: float):
    """(a, b, similarity) of hubs a and the texts b that come after them. Rows come sorted by hub and chunk, the hub's
    own text first; a hub's text may be in an earlier slice than those that it is compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.zeros(0, U64), np.zeros(0)
        last = None
        for batch in text_slices(batches):
            text, h, weight, _ = shingles(batch.column("text"))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            found = []
            for k, (a, chunk, member, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "member", "id")))):
                row = a, chunk, member, b
                own = h[cuts[k] : cuts[k + 1]], weight[cuts[k] : cuts[k + 1]]
                if not member:
                    hub = own
                elif row != last and (got := probability_jaccard(*hub, *own)) >= least:
                    found.append((a, b, got))
                last = row
            cols = list(zip(*found)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])

    return run


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix(h) % U64(SLOTS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for batch in text_slices(batches):
        np.add.at(total, _slots(shingles(batch.column("text"))[1]), 1)
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["slot", "n"])


def _prefixes(counts, least: float):
    """Of each text its rarest shingles, up to the first by which more than 1 - least of its weight is reached."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            text, h, weight, _ = shingles(batch.column("text"))
            total, most = np.bincount(text, weight, batch.num_rows), np.zeros(batch.num_rows)
            np.maximum.at(most, text, weight)
            order = np.lexsort((h, counts.value[_slots(h)], text))
            text, h, weight = text[order], h[order], weight[order]
            left = weight.cumsum() - weight
            left = total[text] - (left - left[np.searchsorted(text, text)])
            early = left >= least * total[text] - 1e-6
            text, h, left = text[early], h[early], left[early]
            rows = pa.array(text)
            cols = [h.view(np.int64), batch.column("id").take(rows), batch.column("component").take(rows), left, total[text], most[text] <= 1]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], ["shingle", "id", "component", "left", "total", "plain"])

    return found


def small_side(staged: DataFrame) -> DataFrame:
    """A written table of ids as one side of a join with the texts: broadcast if it has few rows, so that the texts
    stay where they are, else both sides are shuffled."""
    return F.broadcast(staged) if staged.count() <= BROADCAST_ROWS else staged


def rare_pairs(members: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b), a < b: pairs of members (id, component) of different components, among them every pair with a similarity
    of least or more.

    The similarity is at most the sum of the smaller shares that the two texts' weights give a shingle. So with all
    shingles in one order, a similar pair has a common one in the first of each text that hold more than 1 - least of its
    weight. Rare ones come first, so what many texts have in common brings no pairs. Of a shingle's texts those in the
    component with most of them are not paired with each other. If no shingle comes twice in either text, the similarity
    is that of the sets, and what is left of both from their first common shingle on must hold what they have in common:
    least / (1 + least) of the two sizes together.
    """
    spark = members.sparkSession
    held = workspace.stage(small_side(workspace.stage(members, "rest-members")).join(texts, "id").select("id", "component", "text"), "rest")
    every = max(1, held.count() // COUNTED)
    some = held.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text")
    found = some.mapInArrow(_counted, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    counts = np.zeros(SLOTS, np.int32)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    marks = held.mapInArrow(_prefixes(spark.sparkContext.broadcast(counts), least), "shingle long, id long, component long, left double, total double, plain boolean")
    marks = workspace.stage(marks, "prefixes")
    workspace.drop(held)
    sizes = marks.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("k")).filter("k > 1")
    shared = workspace.stage(lists.drop("k"), "majors")  # written, so that Spark can split a shingle that very many texts have
    several = workspace.stage(marks.join(shared, "shingle"), "shared-shingles")
    workspace.drop(shared)
    workspace.drop(marks)
    minor = several.filter("component <> major").select("shingle", F.col("id").alias("other"), *(F.col(c).alias(c + "_b") for c in ("component", "left", "total", "plain")))
    common = F.least("left", "left_b") >= (F.col("total") + F.col("total_b")) * (least / (1 + least)) - 1e-6
    pairs = several.join(minor, "shingle").filter(F.col("component") != F.col("component_b")).filter(~(F.col("plain") & F.col("plain_b")) | common)
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of ids with a similarity of least or more. classes: (id, registers), texts:
    (id, text), one row for each id of both.

    Pairs that agree on too few registers go before any text is moved. Then each b's text moves to its hub a, which is
    shingled once for CHUNK of them or fewer, so that no hub's pairs must be in one task.
    """
    side = lambda x: classes.select(F.col("id").alias(x), F.col("registers").alias("registers_" + x))
    near = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "registers_a", "registers_b")
    near = workspace.stage(near.mapInArrow(_alike(enough(least)), "a long, b long"), "alike")
    crowded = workspace.stage(near.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).filter("chunks > 1"), "crowded")
    chunk = F.coalesce(F.pmod(F.xxhash64("b"), F.col("chunks")), F.lit(0)).cast("int")
    dealt = near.join(crowded, "a", "left").select("a", chunk.alias("chunk"), "b")
    hubs = dealt.select("a", "chunk").distinct().select("a", "chunk", F.lit(0).alias("member"), F.col("a").alias("id"))
    wanted = hubs.unionByName(dealt.select("a", "chunk", F.lit(1).alias("member"), F.col("b").alias("id")))
    wanted = workspace.stage(wanted, "wanted")
    rows = small_side(wanted).join(texts, "id").select("a", "chunk", "member", "id", "text")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "member", "id")
    found = workspace.stage(rows.mapInArrow(_similar(least - 1e-9), "a long, b long, similarity double"), "links")
    for made in (near, crowded, wanted):
        workspace.drop(made)
    return found


def _open(entries: DataFrame, components: DataFrame) -> DataFrame:
    """Entries (key, id, n, lo) with the component of their id, its own id where it has no links, of the buckets that
    have several components."""
    found = entries.drop("component").join(components.withColumnsRenamed({"node": "id"}), "id", "left")
    labelled = workspace.stage(found.withColumn("component", F.coalesce("component", "id")), "labelled")
    several = labelled.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 <> c1").select("key")
    several = workspace.stage(several, "several")  # written, so that Spark can split a bucket of very many members
    opened = workspace.stage(labelled.join(several, "key"), "entries")
    workspace.drop(labelled)
    workspace.drop(several)
    return opened


def _small(opened: DataFrame) -> DataFrame:
    """a, b: the pairs, a < b, of different components in buckets of up to FEW members but for those with the bucket's
    first member, which were compared at first."""
    few = opened.filter(F.col("n") <= FEW)
    other = few.select("key", F.col("id").alias("b"), F.col("component").alias("component_b"))
    left = few.filter("id <> lo").select("key", F.col("id").alias("a"), "component")
    return left.join(other, "key").filter("a < b AND component <> component_b").select("a", "b")


def _hubs(opened: DataFrame, level: int) -> DataFrame:
    """a, b: hubs of up to HUBS components in a bucket of over FEW members, not the same ones at every level, and the
    members of other components whose largest bucket it is."""
    large = opened.filter(F.col("n") > FEW).select("key", "id", "component", "n")
    turn = F.xxhash64("component", F.lit(level))
    first = large.groupBy("key", F.pmod(turn, F.lit(HUBS)).alias("slot")).agg(F.min(F.struct(turn.alias("turn"), "component", "id")).alias("h"))
    first = workspace.stage(first.select("key", F.col("h.component").alias("hub_component"), F.col("h.id").alias("a")), "hubs")
    members = large.groupBy("id", "component").agg(F.max(F.struct("n", "key")).alias("m")).select(F.col("id").alias("b"), "component", F.col("m.key").alias("key"))
    return members.join(first, "key").filter("component <> hub_component").select("a", "b")


def links(classes: DataFrame, texts: DataFrame, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity) of verified pairs of classes (id, bands, registers), and the components that they make (node,
    component).

    At first all members of a bucket meet its first one, which makes one component of a cluster of near copies at the
    cost of one pair a member. Buckets that have several components then are compared pair by pair if they are small; in
    larger ones members meet the hubs of a few components, and what is in several components even then is paired by
    rare_pairs(), which misses no similar pair. So each similar pair that shares a band is compared or in one component.
    """
    spark = classes.sparkSession
    every = classes.select("id", F.explode("bands").alias("key"))
    buckets = workspace.stage(every.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo")).filter("n > 1"), "buckets")
    entries = workspace.stage(every.join(buckets, "key"), "entries")
    workspace.drop(buckets)
    made: list[DataFrame] = []
    components = spark.createDataFrame([], "node long, component long")
    for level in range(ROUNDS + 2):
        if not level:
            found = entries.filter("id <> lo").select(F.col("lo").alias("a"), F.col("id").alias("b"))
        else:
            before, entries = entries, _open(entries, components)
            workspace.drop(before)
            if level <= ROUNDS:
                found = _hubs(entries, level)
                found = found.unionByName(_small(entries)) if level == 1 else found
            else:
                found = rare_pairs(entries.select("id", "component").distinct(), texts, least)
        pairs = workspace.stage(found.distinct(), "pairs")
        entries = entries.filter(F.col("n") > FEW) if level else entries  # smaller buckets were compared whole at level 1
        if not pairs.isEmpty():
            made.append(verify(pairs, classes, texts, least))
            if not made[-1].isEmpty():
                known = components.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
                components = workspace.stage(graph.components(known.unionByName(made[-1].select("a", "b"))), "components")
        workspace.drop(pairs)
        if level and entries.isEmpty():
            break
    if not made:
        made.append(spark.createDataFrame([], "a long, b long, similarity double"))
    return reduce(DataFrame.unionByName, made), components


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """One row per row of df: key, class_id and kept. Rows whose texts are linked, directly or over others, by a
    similarity of least or more have the same class_id, the smallest key among them; kept is whether that is the row's.

    Words are lower-cased runs of letters and digits. Texts with the same words are copies and stand for one; so a
    group of copies is never paired. Texts without words, null ones included, and rows with a null key are their own
    class, with the key as class_id. Repeated rows are copies; of a key with several texts one counts for links.
    Further columns are left out.
    """
    workspace.small_batches(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = workspace.stage(rows.mapInArrow(_signed, SIGNED_SCHEMA), "signatures")
    usable = F.col("id").isNotNull() & (F.size("bands") > 0)
    good = signed.filter(usable)
    copies = workspace.stage(good.groupBy("high", "low").agg(F.min("id").alias("first")), "copies")
    one = copies.groupBy("first").agg(F.min(F.struct("high", "low")).alias("x")).select(F.col("first").alias("id"), "x.high", "x.low")
    classes = good.join(one, ["id", "high", "low"], "left_semi").dropDuplicates(["id", "high", "low"])
    classes = workspace.stage(classes.select("id", "bands", "registers"), "classes")
    texts = rows.filter(F.col("id").isNotNull())
    if not good.groupBy("id").count().filter("count > 1").isEmpty():  # of a repeated key one row is to be compared
        texts = texts.groupBy("id").agg(F.max("text").alias("text"))
    _, components = links(classes, texts, least)
    named = copies.join(components.withColumnRenamed("node", "first"), "first", "left")
    named = workspace.stage(named.select("high", "low", F.coalesce("component", "first").alias("class_id")), "named")
    narrow = "id", "high", "low"
    rest = signed.filter(~usable).select("id", F.col("id").alias("class_id"))  # without words: no key to join by
    out = good.select(*narrow).join(named, ["high", "low"], "left").select("id", "class_id").unionByName(rest)
    kept = F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept")
    out = workspace.stage(out.select(F.col("id").alias(key), "class_id", kept), "near-copies")
    for done in (signed, copies, classes, named):
        workspace.drop(done)
    return out
