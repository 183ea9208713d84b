"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regex yields a Boolean query over trigrams of the lower-cased text, in disjunctive form: a text with a match
has all trigrams of one clause. The index holds a posting (trigram, text key) for each trigram of any rule; a clause's
postings are intersected by counting them for each text. Texts that meet a clause are candidates of the rule and are
verified by the regex itself. Rules without mandatory trigrams scan every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans, workspace

#: More alternatives than this, of strings or clauses, are given up for a weaker query, never a wrong one.
MOST = 48


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: of a group and its least length: a match that falls short is dropped
    group: int = 0
    least: int = 0


#: The base kinds as the contract lists them. A run that is too short can't hide a longer one for access
#: and hex, so their least lengths are in the pattern.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Public formats of further credentials.
MORE = (
    Rule("forge", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + MORE

Clauses = frozenset  # of frozensets of trigrams; any one of them must be there as a whole; {frozenset()} says nothing
ALWAYS: Clauses = frozenset({frozenset()})


def _both(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > MOST:
        return a if len(b) > len(a) else b
    return frozenset(x | y for x in a for y in b)


def _grams(strings: frozenset[str]) -> Clauses:
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings) or ALWAYS


def _seq(items) -> tuple[frozenset[str] | None, Clauses]:
    """The strings that a part of a regex stands for, where they are few (else None), and its trigram clauses."""
    run, clauses = frozenset({""}), ALWAYS
    exact = True
    for kind, arg in items:
        strings, inner = _part(kind, arg)
        if strings is not None and len(run) * len(strings) <= MOST:
            run = frozenset(x + y for x in run for y in strings)
        else:
            clauses = _both(_both(clauses, _grams(run)), inner if strings is None else ALWAYS)
            run, exact = (frozenset({""}) if strings is None else strings), False
    return (run, ALWAYS) if exact else (None, _both(clauses, _grams(run)))


def _part(kind, arg) -> tuple[frozenset[str] | None, Clauses]:
    if kind is C.LITERAL:
        return frozenset({chr(arg).lower()}), ALWAYS
    if kind is C.IN and all(k is C.LITERAL for k, _ in arg):
        return frozenset(chr(x).lower() for _, x in arg), ALWAYS
    if kind is C.SUBPATTERN:
        return _seq(arg[3])
    if kind is C.BRANCH:
        parts = [_seq(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST:
            return frozenset().union(*(s for s, _ in parts)), ALWAYS
        clauses = frozenset().union(*(c if s is None else _grams(s) for s, c in parts))
        return None, clauses if len(clauses) <= MOST and frozenset() not in clauses else ALWAYS
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        least, most, body = arg
        strings, clauses = _seq(body)
        if (least, most) == (0, 1) and strings is not None and len(strings) < MOST:
            return strings | {""}, ALWAYS
        if least == 0:
            return None, ALWAYS
        if strings is not None and least == most == 1:
            return strings, ALWAYS
        return None, clauses if strings is None else _grams(strings)
    if kind is C.AT:
        return frozenset({""}), ALWAYS
    return None, ALWAYS


def trigram_query(pattern: str) -> Clauses:
    """Sets of trigrams of the lower-cased text, one of which a text must have as a whole to match pattern; with an
    empty set among them the pattern has no mandatory trigrams."""
    strings, clauses = _seq(_parser.parse(pattern))
    found = clauses if strings is None else _grams(strings)
    return ALWAYS if frozenset() in found else frozenset(c for c in found if not any(other < c for other in found))


def _key(text: Column) -> Column:
    """Texts that share a key share postings, which can only add candidates."""
    return F.xxhash64(text)


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, text_key) for each of the trigrams that a text has, in any case. texts: column text."""
    listed = F.array(*(F.lit(t) for t in trigrams))
    has = spans.bound(F.lower("text"), lambda low: F.filter(listed, lambda t: F.contains(low, t)))
    return texts.select(_key(F.col("text")).alias("text_key"), F.explode(has).alias("trigram"))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(text_key, kinds): for each text that meets a clause, the rules with mandatory trigrams that must be verified."""
    clauses = [
        (rule.kind, number, len(clause), gram)
        for rule in rules
        for number, clause in enumerate(sorted(trigram_query(rule.pattern), key=sorted))
        for gram in sorted(clause)
    ]
    spark = texts.sparkSession
    terms = spark.createDataFrame(clauses, "kind string, clause int, need int, trigram string")
    found = postings(texts, sorted({x[3] for x in clauses})).distinct().join(F.broadcast(terms), "trigram")
    met = found.groupBy("text_key", "kind", "clause", "need").count().filter(F.col("count") == F.col("need"))
    return met.groupBy("text_key").agg(F.collect_set("kind").alias("kinds"))


def _found(text: Column, rule: Rule) -> Column:
    hits = spans.find(text, rule.pattern)
    if rule.least:
        group = lambda x: F.regexp_extract(x["found"], f"^(?:{rule.pattern})$", rule.group)
        hits = F.filter(hits, lambda x: F.length(group(x)) >= rule.least)
    return hits


def joined(found: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end by start, then kind in the given order, comma-joined."""
    place = {kind: k for k, kind in enumerate(kinds)}
    order = F.create_map(*(F.lit(x) for pair in place.items() for x in pair))
    chosen = F.filter(found, lambda x: x["kind"].isin(*kinds))
    keyed = F.transform(chosen, lambda x: F.struct(x["start"], order[x["kind"]], x["stop"], x["kind"].alias("kind")))
    return F.array_join(
        F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "found") -> DataFrame:
    """docs with column into: array<struct<kind, start, stop, found>> of the secrets in the whole text, in code points.

    A null text counts as empty and has none. Repeated rows stay, each with its finds; a column named like into is
    replaced, columns of any other name stay. Texts are scanned whole, however long. Copies of a text share a key of the
    join with its candidates: Spark splits a skewed partition of it. Texts too short for a trigram, such as empty ones,
    are in no posting and are spread.
    """
    indexed = tuple(r for r in rules if trigram_query(r.pattern) != ALWAYS)
    full = F.coalesce(F.col(text), F.lit(""))
    key, kinds = workspace.free(docs.withColumn(into, F.lit(0)), "key", "kinds")
    keys = candidates(docs.select(full.alias("text")), indexed).withColumnsRenamed({"text_key": key, "kinds": kinds})
    own = F.when(F.length(full) < 3, F.xxhash64(F.monotonically_increasing_id())).otherwise(_key(full))
    kept = docs.drop(into) if text != into else docs
    with_kinds = kept.withColumn(key, own).join(keys, key, "left").drop(key)
    none = F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,found:string>>")
    labelled = lambda rule: F.transform(
        _found(full, rule), lambda x: F.struct(F.lit(rule.kind).alias("kind"), x["start"], x["stop"], x["found"])
    )
    asked = lambda r: F.coalesce(F.array_contains(kinds, r.kind), F.lit(False)) if r in indexed else F.lit(True)
    parts = [F.when(asked(rule), labelled(rule)).otherwise(none) for rule in rules]
    return with_kinds.withColumn(into, reduce(F.concat, parts)).drop(kinds)
