"""Pseudonyms against a second implementation in plain Python."""

import datetime as dt
import hashlib
import random
import re
from collections import Counter

from plumbline.llm import pii

SECRET = "a second implementation"
DAY_ONE = dt.date(1800, 1, 1)


def drawn(*parts):
    return int(hashlib.sha256("|".join(map(str, (SECRET, *parts))).encode()).hexdigest()[:15], 16)


def permuted(kind, left, right, a, b):
    for i in range(8):
        if i % 2:
            right = (right + drawn(kind, a, b, i, left)) % b
        else:
            left = (left + drawn(kind, a, b, i, right)) % a
    return left, right


def filled(shape, digits):
    rest = iter(digits)
    return re.sub("[0-9]", lambda _: next(rest), shape)


def luhn(digits):
    twice = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in twice) % 10


def day_of(year, month, day):
    try:
        return dt.date(int(year), int(month), int(day))
    except ValueError:
        return None


def changed(m):
    """kind and pseudonym of what looks like a personal value."""
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        return "email", f"user-{hashlib.sha256(f'{SECRET}|email|{m.lower()}'.encode()).hexdigest()[:16]}@example.invalid"
    if m.count(".") == 3:
        parts = m.split(".")
        if any(str(int(p)) != p or int(p) > 255 for p in parts):
            return "ip", m
        p = [int(x) for x in parts]
        left, right = permuted("ip", p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536)
        return "ip", ".".join(map(str, (*divmod(left, 256), *divmod(right, 256))))
    if len(digits) == 8:
        first = m[:4].isdigit()
        dmy = None if first else day_of(digits[4:], digits[2:4], digits[:2])
        day = day_of(digits[:4], digits[4:6], digits[6:]) if first else dmy or day_of(digits[4:], digits[:2], digits[2:4])
        if not day or not 1800 <= day.year < 2200:
            return "date", m
        left, right = permuted("date", *divmod((day - DAY_ONE).days, 189), 773, 189)
        new = DAY_ONE + dt.timedelta(days=left * 189 + right)
        y, mo, d = f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"
        return "date", filled(m, y + mo + d if first else d + mo + y if dmy else mo + d + y)
    if len(digits) == 9:
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if not 0 < area < 900 or area == 666 or not group or not serial:
            return "ssn", m
        areas = [n for n in range(1, 900) if n != 666]
        left, right = permuted("ssn", areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        return "ssn", f"{areas[left]:03}-{right // 9999 + 1:02}-{right % 9999 + 1:04}"
    if len(digits) in (10, 11):
        left, right = permuted("phone", int(digits[-10:-7]) - 200, int(digits[-7:]) - 2_000_000, 800, 8_000_000)
        return "phone", filled(m, digits[:-10] + str(left + 200) + str(right + 2_000_000))
    if luhn(digits):
        return "card", m
    u = (len(digits) - 2) // 2
    v = len(digits) - 2 - u
    left, right = permuted("card", int(digits[1 : 1 + u]), int(digits[1 + u : -1]), 10**u, 10**v)
    body = digits[0] + str(left).zfill(u) + str(right).zfill(v)
    return "card", filled(m, body + next(c for c in "0123456789" if not luhn(body + c)))


def wanted(text):
    """The text with pseudonyms and how many values of each kind were replaced."""
    counts = Counter()

    def one(match):
        kind, new = changed(match[0])
        counts[kind] += new != match[0]
        return new

    return re.sub(pii.ANY, one, text, flags=re.ASCII), {k: n for k, n in counts.items() if n}


def texts():
    rng = random.Random(7)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    sep = lambda s: rng.choice(s)

    def card(k):
        body = sep("3456") + n(k - 2)
        return body + (next(c for c in "0123456789" if not luhn(body + c)) if rng.random() < 0.8 else n(1))

    def grouped():
        c, s = card(16), sep(" -")
        return s.join(c[k : k + 4] for k in range(0, 16, 4))

    def date():
        s, d = sep("/-"), f"{rng.randint(0, 32):02}{rng.randint(0, 14):02}{rng.randint(1700, 2300)}"
        return sep([f"{d[4:]}{s}{d[2:4]}{s}{d[:2]}", f"{d[:2]}{s}{d[2:4]}{s}{d[4:]}", f"{d[2:4]}.{d[:2]}.{d[4:]}"])

    made = [
        lambda: f"{sep('abX')}{n(2)}.{sep('qZ')}@mail-{n(1)}.{sep(['com', 'co.uk', 'x'])}", lambda: f"({sep('23456789')}{n(2)}) {sep('23456789')}{n(2)}-{n(4)}",
        lambda: f"+1 {sep('2349')}{n(2)}.{sep('259')}{n(2)}.{n(4)}", lambda: ".".join(str(rng.randint(0, 280)) for _ in range(4)), lambda: f"0{n(1)}.1.1.{n(2)}",
        date, date, lambda: f"{n(3)}-{n(2)}-{n(4)}", lambda: f"{sep(['000', '666', '665', '667', '899'])}-{sep(['00', '01'])}-{sep(['0000', '0001', '9999'])}",
        lambda: card(rng.randint(13, 19)), grouped, lambda: n(rng.randint(1, 25)), lambda: sep(["word", "ключ", "$1 \\2", "é@", "1999-"]),
    ]
    some = ["".join(rng.choice(made)() + sep([" ", ", ", "\n", " ", "x", "-", ""]) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    return [*some, "", " ", "no digits", some[0], some[0], " ".join(some[:200])]


def test_against_a_second_implementation(spark):
    given = texts()
    df = spark.createDataFrame(list(enumerate([*given, None])), "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.text, r.pii) for r in pii.pseudonymise(df, SECRET).collect()}
    assert found.pop(len(given)) == (None, {})
    seen = Counter()
    for k, text in enumerate(given):
        assert found[k] == wanted(text), text
        seen.update(found[k][1])
    assert set(seen) == set(pii.KINDS) and min(seen.values()) > 50
