"""Column functions: guards, labels, formats and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is null, NaN or infinite."""
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def present(text: Column) -> Column:
    """text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def or_false(condition: Column) -> Column:
    """A condition that fails where an input is missing."""
    return F.coalesce(condition, F.lit(False))


def first_match(cases: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds."""
    out = F.lit(default)
    for condition, label in reversed(cases):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """The label of key in a small fixed table, else default."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(pairs, key), default)


def midpoint(low: Column, high: Column) -> Column:
    """The middle of a band, or its one finite end."""
    low, high = finite(low), finite(high)
    return F.coalesce((low + high) / 2, low, high)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def plain_dashes(text: Column) -> Column:
    """Long dashes, with the blanks around them, as ' - '."""
    return F.regexp_replace(text, r"\s*[–—]\s*", " - ")


def short_hash(digest: Column) -> Column:
    """First 12 and last 6 characters of a digest without its prefix."""
    bare = F.regexp_replace(digest, "^sha256:", "")
    return F.concat(F.substring(bare, 1, 12), F.lit("..."), F.right(bare, F.lit(6)))



def tagged_hash(digest: Column) -> Column:
    """short_hash with its kind before it, whether or not the digest came with one."""
    return F.concat(F.lit("sha256:"), short_hash(digest))


def linear_scale(x: Column, low: Column, high: Column, to_low: Column, to_high: Column) -> Column:
    """x of the domain low to high in the range to_low to to_high, beyond both ends too; a domain without length counts
    as one of length 1."""
    span = F.when(high == low, 1.0).otherwise(high - low)
    return to_low + (x - low) / span * (to_high - to_low)


def decades(low: Column, high: Column) -> Column:
    """The whole powers of ten from low to high, as exponents; none where no power lies between or an end is not positive."""
    first, last = F.ceil(F.log10(low)).cast("int"), F.floor(F.log10(high)).cast("int")
    return F.when((low > 0) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def smoothstep(x: Column, low: Column, high: Column) -> Column:
    """0 up to low, 1 from high on, and between them the cubic that is level at both; a step at low where they are equal."""
    share = F.when(high == low, (x >= low).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))
    return share * share * (3 - 2 * share)


def on_breakpoints(x: Column, points: Column) -> Column:
    """The height at x of the line through points, array<struct<x, y>>, which are sorted here; level beyond both ends. Of
    points at one place the last in order holds from there on. Null without points."""

    def at(sorted_: Column) -> Column:
        place = F.size(F.filter(sorted_, lambda p: p["x"] <= x))  # points up to x
        a, b = F.try_element_at(sorted_, place), F.try_element_at(sorted_, place + 1)
        between = a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"])
        return F.when(F.size(sorted_) == 0, None).when(place == 0, F.try_element_at(sorted_, F.lit(1))["y"]).when(place == F.size(sorted_), a["y"]).otherwise(between)

    return F.transform(F.array(F.array_sort(points)), at)[0]


def boolean_entries(document: Column) -> Column:
    """map<string, boolean> of the entries of a JSON object whose values are booleans; numbers, strings, nulls, lists and
    objects are no gates. Null for what is no JSON object."""
    whole = F.try_parse_json(document)
    entries = F.when(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), whole).cast("map<string,variant>")
    return F.transform_values(F.map_filter(entries, lambda _, v: F.schema_of_variant(v) == "BOOLEAN"), lambda _, v: v.cast("boolean"))


def shortened(key: Column, most: int = 20, keep: int = 16) -> Column:
    return F.when(F.length(key) > most, F.concat(F.substring(key, 1, keep), F.lit("…"))).otherwise(key)


def slug(text: Column) -> Column:
    """Lower case with runs of other characters than letters, digits and '-' as one '-', none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9-]+", "-"), "^-+|-+$", "")


def titled(text: Column) -> Column:
    """Underscores as blanks and each word's first letter in upper case, the rest as it is."""
    words = F.transform(F.split(text, "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(words, " ")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


def padded(number: Column, width: int = 2) -> Column:
    """Zero-padded, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def signed_percent(x: Column, digits: int = 2) -> Column:
    """'+1234.50%', thousands not grouped; zero has no sign; null where x is not finite."""
    x = finite(x)
    return F.concat(F.when(x > 0, "+").otherwise(""), F.format_string(f"%.{digits}f", x), F.lit("%"))


def compact_amount(x: Column) -> Column:
    """12.5K, 3M, 2.0B: one digit only where it is not whole."""

    def scaled(unit: float, suffix: str) -> Column:
        v = x / unit
        return F.concat(F.when(v == F.floor(v), F.format_string("%d", F.floor(v).cast("long"))).otherwise(F.format_string("%.1f", v)), F.lit(suffix))

    return F.when(x >= 1e9, scaled(1e9, "B")).when(x >= 1e6, scaled(1e6, "M")).when(x >= 1e3, scaled(1e3, "K")).otherwise(
        F.format_string("%.0f", x)
    )


def number_and_suffix(text: Column) -> tuple[Column, Column]:
    """'1,234.5 bps' as 1234.5 and ' bps'; null and the text where there is no leading number."""
    pattern = r"^([0-9,]+(?:\.[0-9]+)?)(.*)$"
    digits = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", "")
    return digits.try_cast("double"), F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 2)).otherwise(text)


def stated_range(text: Column) -> tuple[Column, Column]:
    """The two numbers of 'a to b', null where there are none."""
    pattern = r"([0-9.]+)\s+to\s+([0-9.]+)"
    return tuple(F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))


def valid_address(text: Column) -> Column:
    """Whether a trimmed, lower-cased mail address is short enough and well formed."""
    address = F.lower(F.trim(text))
    return or_false((address != "") & (F.length(address) <= 254) & address.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"))



def money(x: Column) -> Column:
    """'$1,234': whole units, halves up; null where x is not finite."""
    return F.concat(F.lit("$"), F.format_number(F.floor(finite(x) + 0.5), 0))


def short_money(x: Column) -> Column:
    """'$1.5B', '$10M', '$250k' or '$12': one digit only of what is not whole, none of thousands; null where x is not
    finite."""
    x = finite(x)
    scaled = lambda unit: F.format_string("%.1f", x / unit) if unit > 1e3 else F.format_string("%.0f", x / unit)
    whole = lambda unit: F.format_string("%.0f", x / unit)
    shown = lambda unit: F.when(x % unit == 0, whole(unit)).otherwise(scaled(unit))
    cases = [F.concat(shown(unit), F.lit(suffix)) for unit, suffix in ((1e9, "B"), (1e6, "M"), (1e3, "k"))]
    low = F.floor(x + 0.5).cast("string")
    return F.concat(F.lit("$"), F.when(x >= 1e9, cases[0]).when(x >= 1e6, cases[1]).when(x >= 1e3, cases[2]).otherwise(low))


def span_of_days(days: Column) -> Column:
    """'2.5y' from a year of 365.25 days on, else '40d'; null where days is not finite."""
    years = finite(days.cast("double")) / 365.25
    return F.when(years >= 1, F.format_string("%.1fy", years)).otherwise(F.concat(F.floor(finite(days.cast("double")) + 0.5).cast("string"), F.lit("d")))


def range_label(low: Column, high: Column, digits: int, suffix: str = "") -> Column:
    """'0.70 to 0.80' and the suffix, or the one end that is finite; null where none is."""
    shown = [F.when(finite(x).isNotNull(), F.format_string(f"%.{digits}f", finite(x))) for x in (low, high)]
    return F.concat(F.coalesce(F.concat(shown[0], F.lit(" to "), shown[1]), *shown), F.lit(suffix))


def escaped(text: Column) -> Column:
    """Text as it stands in HTML: & first, then < and >."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def joined_parts(parts: list[Column], separator: str) -> Column:
    """The parts that are neither null nor empty, in order; empty where there are none."""
    return F.concat_ws(separator, *(present(p) for p in parts))


def intake(trap: Column, address: Column) -> Column:
    """What becomes of a submitted form: dropped where its trap field, which no person sees, is filled (it is answered
    like an accepted one and nothing is stored), else accepted or invalid by the address. Only blanks in the trap count
    as nothing."""
    return F.when(or_false(F.trim(trap) != ""), "dropped").when(valid_address(address), "accepted").otherwise("invalid")


def body_fields(body: Column, fields: list[str]) -> dict[str, Column]:
    """Fields of a request body: JSON if it parses, else name=value pairs joined by '&'."""
    parsed = F.from_json(body, "map<string,string>")
    pairs = F.str_to_map(body, F.lit("&"), F.lit("="))
    decode = lambda x: F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%20")))
    is_json = F.ltrim(body).startswith("{")
    return {f: F.when(is_json, F.try_element_at(parsed, F.lit(f))).otherwise(decode(F.try_element_at(pairs, F.lit(f)))) for f in fields}
