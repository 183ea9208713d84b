"""Format-preserving pseudonyms for personal numbers, addresses and dates, with DataFrame functions only.

A value that passes its kind's check is split into two numbers, left below a and right below b, that cover exactly the
valid values of its format (a card's check digit is computed, a date is a day of the Gregorian cycle). A Feistel network
over them whose round function is a keyed SHA-256 permutes the format: pseudonyms are valid, different values stay
different, and equal values stay equal in every document. E-mail addresses, which have no such numbers, get a keyed
digest of the same form. Whoever has the key can undo the permutations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans, workspace

ROUNDS = 8
#: Days of the 400-year Gregorian cycle from 1800-01-01 to 2199-12-31.
CYCLE = 146_097
FIRST_DAY = "1800-01-01"

#: What the kinds look like. Only those that pass the checks below are replaced.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
PHONE = r"(?<![\w+])(?:\+1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.-])[2-9]\d{2}[.-]\d{4}(?![\w-])"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\w)"
DAY = r"(?<![\w/-])\d{4}([/-])\d{2}\1\d{2}(?![\w/-])"
DAY_LAST = r"(?<![\w./-])\d{2}([./-])\d{2}\2\d{4}(?![\w/-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\3\d{4}\3\d{4}|\d{4}([ -])\d{6}\4\d{5})(?![\w-])"
KINDS = ("email", "phone", "ip", "date", "ssn", "card")
#: The groups of the whole pattern: the separators of the date shapes (1, 2) and of cards (3, 4).
ANY = "|".join((EMAIL, PHONE, IP, DAY, DAY_LAST, SSN, CARD))


@dataclass(frozen=True)
class Key:
    """What the round function is keyed with."""

    secret: str

    def number(self, *parts: Column | str) -> Column:
        """A keyed number of 60 bits that depends on parts."""
        text = F.concat_ws("|", F.lit(self.secret), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: Key, kind: str, undo: bool = False) -> Column:
    """struct<l, r> of the pair (left < a, right < b) permuted with all other such pairs: the rounds add to either half
    in turn, modulo its range, so no value needs a second try. The ranges are part of what the rounds depend on."""
    sign = -1 if undo else 1
    numbers = F.sequence(F.lit(ROUNDS - 1 if undo else 0), F.lit(0 if undo else ROUNDS - 1))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        drawn = lambda half, m: sign * (key.number(kind, a, b, i, half) % m)
        even = F.struct(F.pmod(s["l"] + drawn(s["r"], a), a).cast("long").alias("l"), s["r"].alias("r"))
        odd = F.struct(s["l"].alias("l"), F.pmod(s["r"] + drawn(s["l"], b), b).cast("long").alias("r"))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return F.aggregate(numbers, start, step)


def _num(digits: Column, at: int, n: int | Column) -> Column:
    return F.substr(digits, F.lit(at), F.lit(n) if isinstance(n, int) else n).cast("long")


def _pad(number: Column, n: int | Column) -> Column:
    return F.lpad(number.cast("string"), n, F.lit("0"))


def _fill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by digits."""
    places = F.sequence(F.lit(1), F.length(shape))
    nth = lambda i: F.length(F.regexp_replace(F.substr(shape, F.lit(1), i), r"\D", ""))
    cell = lambda d, i, c: F.when(c.rlike(r"\d"), F.substr(d, nth(i), F.lit(1))).otherwise(c)
    return spans.bound(
        digits, lambda d: F.array_join(F.transform(places, lambda i: cell(d, i, F.substr(shape, i, F.lit(1)))), "")
    )


def luhn_sum(digits: Column) -> Column:
    """The sum of digits whose last place weighs 1; a number is valid if it is a multiple of ten."""
    places = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: (lambda d, twice: F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))(
            F.substr(digits, i, F.lit(1)).cast("int"), (F.length(digits) - i) % 2 == 1
        ),
    )
    return F.aggregate(places, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: Key, undo: bool) -> Column:
    """First digit and length stay, the rest is permuted, the check digit computed."""

    def change(digits: Column) -> Column:
        free = F.length(digits) - 2
        u = F.floor(free / 2).cast("int")
        v = free - u
        power = lambda n: F.pow(F.lit(10.0), n).cast("long")
        new = feistel(_num(digits, 2, u), F.substr(digits, u + 2, v).cast("long"), power(u), power(v), key, "card", undo)
        body = spans.bound(new, lambda s: F.concat(F.substr(digits, F.lit(1), F.lit(1)), _pad(s["l"], u), _pad(s["r"], v)))
        return spans.bound(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))

    return spans.bound(
        F.regexp_replace(m, r"\D", ""), lambda d: F.when(luhn_sum(d) % 10 == 0, _fill(m, change(d))).otherwise(m)
    )


def _phone(m: Column, key: Key, undo: bool) -> Column:
    """Area code and exchange begin with 2 to 9; a country code stays."""

    def change(d: Column) -> Column:
        new = feistel(_num(d, 1, 3) - 200, _num(d, 4, 7) - 2_000_000, F.lit(800), F.lit(8_000_000), key, "phone", undo)
        return spans.bound(new, lambda s: F.concat((s["l"] + 200).cast("string"), (s["r"] + 2_000_000).cast("string")))

    whole = F.regexp_replace(m, r"\D", "")
    return spans.bound(whole, lambda d: _fill(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), change(F.right(d, F.lit(10))))))


def _ip(m: Column, key: Key, undo: bool) -> Column:
    def change(parts: Column) -> Column:
        n = lambda k: parts[k].cast("long")
        new = feistel(n(0) * 256 + n(1), n(2) * 256 + n(3), F.lit(65_536), F.lit(65_536), key, "ip", undo)
        return spans.bound(new, lambda s: F.concat_ws(".", *(x.cast("long").cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256))))

    valid = lambda p: F.forall(p, lambda x: x.rlike("^(0|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    return spans.bound(F.split(m, r"\."), lambda p: F.when(valid(p), change(p)).otherwise(m))


def _date(m: Column, key: Key, undo: bool) -> Column:
    """Days of 400 years; the order of the parts and the separators stay. Day comes before month where the year is last
    and that makes a date, else month before day; undoing takes the pseudonym's own order, so only dates with the month
    second are sure to come back."""
    digits = F.regexp_replace(m, r"\D", "")
    iso = lambda y, mo, d: F.concat_ws("-", y, mo, d)
    cut = lambda s, at, n: F.substr(s, F.lit(at), F.lit(n))
    day = lambda text: F.try_to_date(text, "yyyy-MM-dd")
    first = m.rlike(r"^\d{4}")

    def choose(d: Column) -> Column:
        ymd = day(iso(cut(d, 1, 4), cut(d, 5, 2), cut(d, 7, 2)))
        dmy = day(iso(cut(d, 5, 4), cut(d, 3, 2), cut(d, 1, 2)))
        mdy = day(iso(cut(d, 5, 4), cut(d, 1, 2), cut(d, 3, 2)))
        return F.struct(F.when(first, ymd).otherwise(F.coalesce(dmy, mdy)).alias("day"), F.when(first, "y").when(dmy.isNotNull(), "d").otherwise("m").alias("order"))

    def change(x: Column) -> Column:
        at = F.date_diff(x["day"], F.lit(FIRST_DAY).cast("date")).cast("long")
        new = feistel(F.floor(at / 189), at % 189, F.lit(773), F.lit(189), key, "date", undo)
        moved = spans.bound(new, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * 189 + s["r"]).cast("int")))
        shown = lambda t: F.when(x["order"] == "y", F.date_format(t, "yyyyMMdd")).when(x["order"] == "d", F.date_format(t, "ddMMyyyy")).otherwise(F.date_format(t, "MMddyyyy"))
        return _fill(m, spans.bound(moved, shown))

    known = lambda x: x["day"].between(FIRST_DAY, "2199-12-31")
    return spans.bound(spans.bound(digits, choose), lambda x: F.when(known(x), change(x)).otherwise(m))


def _ssn(m: Column, key: Key, undo: bool) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = _num(m, 1, 3), _num(m, 5, 2), _num(m, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = feistel(left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", undo)
    shown = lambda s: F.concat_ws("-", _pad(s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0), 3), _pad(F.floor(s["r"] / 9999) + 1, 2), _pad(s["r"] % 9999 + 1, 4))
    return F.when(valid, spans.bound(new, shown)).otherwise(m)


def _email(m: Column, key: Key, undo: bool) -> Column:
    """Not undone. The domain is one that never exists."""
    digest = F.sha2(F.concat_ws("|", F.lit(key.secret), F.lit("email"), F.lower(m)), 256)
    return m if undo else F.concat(F.lit("user-"), F.substr(digest, F.lit(1), F.lit(16)), F.lit("@example.invalid"))


CHANGES = {"email": _email, "phone": _phone, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card}


def kind_of(m: Column) -> Column:
    """The kind that a match of ANY looks like."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), "ip")
        .when(whole(r"\d{4}[/-]\d{2}[/-]\d{2}|\d{2}[./-]\d{2}[./-]\d{4}"), "date")
        .when(whole(r"\d{3}-\d{2}-\d{4}"), "ssn")
        .when(whole(PHONE), "phone")
        .otherwise("card")
    )


def _changed(m: Column, key: Key, undo: bool) -> Column:
    def by_kind(kind: Column) -> Column:
        out = F.when(kind == KINDS[0], CHANGES[KINDS[0]](m, key, undo))
        for k in KINDS[1:]:
            out = out.when(kind == k, CHANGES[k](m, key, undo))
        return out

    return spans.bound(kind_of(m), by_kind)


def pseudonymise(docs: DataFrame, secret: str, text: str = "text", counts: str | None = "pii", undo: bool = False) -> DataFrame:
    """docs with the personal values in the whole of column text replaced; with counts, a column of that name has
    map<kind, number of replaced values>, replacing one there was.

    secret keys the permutations: the same secret links equal values across documents, jobs and tables. Values that
    look like a kind but fail its check stay. A null text stays null with an empty map, an empty one stays empty. With
    undo the permuted values are turned back, e-mail addresses apart. Rows are independent of each other: nothing is
    shuffled.
    """
    key = Key(secret)
    full = F.col(text)
    # texts without a digit or @ have nothing to look for
    due = full.rlike("[0-9@]")
    one = lambda m: _changed(m, key, undo)
    if counts is None:
        return docs.withColumn(text, F.when(due, spans.rewrite(full, ANY, one)).otherwise(full))
    hits = F.regexp_extract_all(full, F.lit(ANY), 0)
    pairs = F.transform(hits, lambda m: F.struct(m.alias("old"), one(m).alias("new"), kind_of(m).alias("kind")))
    none = F.array().cast("array<struct<old:string,new:string,kind:string>>")
    [held_in] = workspace.free(docs.withColumn(counts, F.lit(0)), "pairs")
    held = docs.drop(counts).withColumn(held_in, F.when(due & full.rlike(ANY), pairs).otherwise(none))
    gaps = F.split(full, ANY, -1)
    joined = spans.bound(
        gaps,
        lambda g: F.concat(
            F.array_join(F.zip_with(F.slice(g, F.lit(1), F.size(held_in)), F.col(held_in), lambda x, p: F.concat(x, p["new"])), ""),
            F.element_at(g, -1),
        ),
    )
    real = F.filter(held_in, lambda p: p["old"] != p["new"])
    tally = F.map_from_arrays(
        F.array(*(F.lit(k) for k in KINDS)),
        F.array(*(_count(real, k) for k in KINDS)),
    )
    return held.withColumn(counts, F.map_filter(tally, lambda _, n: n > 0)).withColumn(
        text, F.when(F.size(held_in) > 0, joined).otherwise(full)
    ).drop(held_in)


def _count(pairs: Column, kind: str) -> Column:
    return F.size(F.filter(pairs, lambda p: p["kind"] == kind))
