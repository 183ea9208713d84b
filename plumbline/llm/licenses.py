"""Licence recognition by sentence rules, with DataFrame functions only.

A text is cut into sentences, which are normalised and mapped to identifiers of known licence sentences. The sequence of
identifiers is then matched against ordered rules, each a run of identifiers that stands for a licence: a rule that
matches takes its identifiers, so a longer rule comes before those that are part of it. A sentence that names a licence
("Licensed under the MIT license", "SPDX-License-Identifier: MIT") has an identifier of its own for each licence, which
is a rule too, after all others; names joined by "and", "or" and "with" are one expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence families, what they are called besides their own name, and their versions.
FAMILIES = (
    ("Apache", (), ("1.0", "1.1", "2.0")), ("GPL", ("general public",), ("1.0", "2.0", "3.0")),
    ("LGPL", ("lesser general public", "library general public"), ("2.0", "2.1", "3.0")), ("AGPL", ("affero general public",), ("1.0", "3.0")),
    ("MPL", ("mozilla public",), ("1.0", "1.1", "2.0")), ("EPL", ("eclipse public",), ("1.0", "2.0")), ("EUPL", ("european union public",), ("1.0", "1.1", "1.2")),
    ("CDDL", ("common development and distribution",), ("1.0", "1.1")), ("CPL", ("common public",), ("1.0",)), ("OFL", ("sil open font", "open font"), ("1.0", "1.1")),
    ("AFL", ("academic free",), ("1.1", "1.2", "2.0", "2.1", "3.0")), ("OSL", ("open",), ("1.0", "1.1", "2.0", "2.1", "3.0")), ("Artistic", (), ("1.0", "2.0")),
    ("BSL", ("boost",), ("1.0",)), ("LPPL", ("latex project public",), ("1.0", "1.1", "1.2", "1.3a", "1.3c")), ("PHP", (), ("3.0", "3.01")),
    ("ZPL", ("zope public",), ("1.1", "2.0", "2.1")), ("PSF", ("python foundation",), ("2.0",)), ("GFDL", ("free documentation",), ("1.1", "1.2", "1.3")),
    ("ECL", ("educational community",), ("1.0", "2.0")), ("CECILL", ("cecill",), ("1.0", "1.1", "2.0", "2.1")), ("MulanPSL", ("mulan permissive",), ("1.0", "2.0")),
    ("ODbL", ("open database",), ("1.0",)), ("CC0", ("creative commons zero",), ("1.0",)),
)
#: The parts of a Creative Commons licence, their names, and versions.
CC_PARTS = (("by", "attribution"), ("nc", "noncommercial"), ("nd", "noderivatives"), ("sa", "sharealike"))
CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Licences without versions and what they are called besides their own name.
SINGLE = (
    ("MIT", ("expat", "mit expat")), ("MIT-0", ("mit no attribution",)), ("ISC", ()), ("Zlib", ("zlib libpng",)), ("Unlicense", ()), ("WTFPL", ("do what the fuck you want to public",)),
    ("0BSD", ("zero clause bsd", "bsd zero clause")), ("BSD-2-Clause", ("2 clause bsd", "simplified bsd", "freebsd", "bsd 2")),
    ("BSD-3-Clause", ("3 clause bsd", "new bsd", "modified bsd", "revised bsd", "bsd 3")), ("BSD-4-Clause", ("4 clause bsd", "original bsd")), ("BSD", ("berkeley distribution",)),
    ("NCSA", ("university illinois ncsa open source",)), ("X11", ()), ("curl", ()), ("Ruby", ()), ("PostgreSQL", ()), ("Vim", ()), ("Beerware", ()), ("JSON", ()),
    ("BlueOak-1.0.0", ("blue oak model 1.0.0",)), ("MS-PL", ("microsoft public",)), ("MS-RL", ("microsoft reciprocal",)), ("Public-Domain", ("public domain",)),
)
#: Identifiers of known sentences and what they look like once normalised: lower case, letters, digits and
#: inner dots only, single blanks. The first that fits is taken.
_IT = "(?:program|library|file|software|package)"
_ANY = f"(?:this {_IT}|[a-z0-9][a-z0-9.]{{0,40}}(?: [a-z0-9][a-z0-9.]{{0,40}}){{0,5}})"
_MODIFY = "you can redistribute it and or modify it under the terms of (?:version [0-9.]+ of )?the gnu "
_ONE = f"^{_ANY} is free software {_MODIFY}"
SENTENCES = (
    ("ApacheComply", "^you may not use this (?:file|work|software) except in compliance with the licen[sc]e$"),
    ("ApacheCopy", "^you may obtain a copy of the licen[sc]e at"),
    ("ApacheAsIs", "^unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("BoostPermission", "^permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("MitPermission", "^permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", "^the above copyright notice and this permission notice .{0,60}shall be included in all copies"),
    ("AsIs", "^(?:the|this) software is provided .{0,60}as is"),
    ("IscPermission", "^permission to use copy modify and or distribute this software for any purpose"),
    ("ZlibPermission", "^permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("ZlibOrigin", "^(?:1\\.? )?the origin of this software must not be misrepresented"),
    ("ZlibAltered", "^(?:2\\.? )?altered source versions must be plainly marked as such"),
    ("ZlibNotice", "^(?:3\\.? )?this notice may not be removed or altered from any source distribution"),
    ("Unencumbered", "^this is free and unencumbered software released into the public domain"),
    ("AgplOne3", _ONE + "affero general public licen[sc]e .{0,80}version 3"),
    ("LgplOne3", _ONE + "lesser general public licen[sc]e .{0,80}version 3"),
    ("LgplOne21", _ONE + "lesser general public licen[sc]e .{0,80}version 2\\.1"),
    ("GplOne3", _ONE + "general public licen[sc]e .{0,80}version 3"),
    ("GplOne2", _ONE + "general public licen[sc]e .{0,80}version 2"),
    ("FreeSoftware", f"^{_ANY} is free software$"),
    ("AgplModify", "^" + _MODIFY + "affero general public licen[sc]e"),
    ("LgplModify", "^" + _MODIFY + "(?:lesser|library) general public licen[sc]e"),
    ("GplModify", "^" + _MODIFY + "general public licen[sc]e"),
    ("Either3", "^either version 3 of the licen[sc]e"),
    ("Either21", "^either version 2\\.1 of the licen[sc]e"),
    ("Either2", "^either version 2 of the licen[sc]e"),
    ("GplHope", f"^{_ANY} is distributed in the hope that it will be useful"),
    ("BsdUse", "^redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", "^(?:1\\.? )?redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", "^(?:2\\.? )?redistributions in binary form must reproduce the above copyright notice"),
    ("BsdAdvertise", "^(?:3\\.? )?all advertising materials mentioning features or use of this software must display"),
    ("BsdEndorse", "^(?:[34]\\.? )?neither the name .{1,120} may be used to endorse or promote products"),
    ("MplForm", "^this source code form is subject to the terms of the mozilla public licen[sc]e v\\.?(?:ersion)?$"),
    ("MplForm2", "^this source code form is subject to the terms of the mozilla public licen[sc]e (?:v\\.? ?|version )2\\.0"),
    ("Two", "^2\\.0$"),
    ("MplCopy", "^if a copy of the mpl was not distributed with this file"),
    ("EplMaterials", "^this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v?\\.? ?2\\.0"),
    ("Cc0Waive", "^to the extent possible under law .{1,120} waived all copyright"),
    ("Reserved", "^(?:copyright .{0,80})?all rights reserved$"),
)
#: Licences and the runs of identifiers that stand for them, in order.
RULES = (
    ("Apache-2.0", ("ref:Apache-2.0", "ApacheComply", "ApacheCopy", "ApacheAsIs")), ("Apache-2.0", ("ref:Apache-2.0", "ApacheComply")),
    ("Apache-2.0", ("ApacheComply", "ApacheCopy")),
    ("BSL-1.0", ("BoostPermission",)), ("MIT", ("MitPermission", "MitNotice", "AsIs")), ("MIT", ("MitPermission", "MitNotice")), ("MIT-0", ("MitPermission", "AsIs")),
    ("ISC", ("IscPermission", "AsIs")), ("ISC", ("IscPermission",)),
    ("Zlib", ("ZlibPermission", "ZlibOrigin", "ZlibAltered", "ZlibNotice")), ("Zlib", ("ZlibPermission",)), ("Unlicense", ("Unencumbered",)),
    ("AGPL-3.0", ("AgplOne3", "GplHope")), ("AGPL-3.0", ("AgplOne3",)), ("AGPL-3.0", ("FreeSoftware", "AgplModify", "Either3")),
    ("LGPL-3.0", ("LgplOne3", "GplHope")), ("LGPL-3.0", ("LgplOne3",)), ("LGPL-3.0", ("FreeSoftware", "LgplModify", "Either3")),
    ("LGPL-2.1", ("LgplOne21", "GplHope")), ("LGPL-2.1", ("LgplOne21",)), ("LGPL-2.1", ("FreeSoftware", "LgplModify", "Either21")),
    ("GPL-3.0", ("GplOne3", "GplHope")), ("GPL-3.0", ("GplOne3",)), ("GPL-3.0", ("FreeSoftware", "GplModify", "Either3")),
    ("GPL-2.0", ("GplOne2", "GplHope")), ("GPL-2.0", ("GplOne2",)), ("GPL-2.0", ("FreeSoftware", "GplModify", "Either2", "GplHope")), ("GPL-2.0", ("FreeSoftware", "GplModify", "Either2")),
    ("BSD-4-Clause", ("BsdUse", "BsdSource", "BsdBinary", "BsdAdvertise", "BsdEndorse")), ("BSD-3-Clause", ("BsdUse", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdUse", "BsdSource", "BsdBinary")), ("MPL-2.0", ("MplForm", "Two", "MplCopy")), ("MPL-2.0", ("MplForm", "Two")), ("MPL-2.0", ("MplForm2", "MplCopy")),
    ("MPL-2.0", ("MplForm2",)), ("EPL-2.0", ("EplMaterials",)), ("CC0-1.0", ("Cc0Waive",)), ("proprietary", ("Reserved",)),
)
#: Names that say nothing without a version ("an open license").
NOT_ALONE = ("open",)
#: Exceptions to licences, as tags write them.
EXCEPTIONS = (
    "Autoconf-exception-2.0", "Autoconf-exception-3.0", "Bison-exception-2.2", "Bootloader-exception", "Classpath-exception-2.0", "FLTK-exception", "Font-exception-2.0",
    "GCC-exception-2.0", "GCC-exception-3.1", "Libtool-exception", "Linux-syscall-note", "LLVM-exception", "OCaml-LGPL-linking-exception", "Qt-LGPL-exception-1.1", "u-boot-exception-2.0", "WxWindows-exception-3.1",
)
#: How a sentence that names licences begins, what may stand between the words of a name, what joins names,
#: and the words that may come after the last name.
NAMES_IT = "^(?:(?:this|the|use of (?:this|the)) [a-z ]{1,60} (?:is|are) |it is |dual )?(?:licensed|released|distributed|available|published|provided|governed) (?:under|by) (?:the )?(?:terms of (?:the )?)?"
TAG = "^(?:spdx licen[sc]e identifier|licen[sc]e) "
LATER = "or (?:at your option )?(?:any )?later(?: version)?"
FILLERS = r"\b(?:the|an?|terms|of|either|both|licen[sc]es?|version|gnu|software|international|unported|only)\b"
JOINS = (("and or", " OR "), ("or", " OR "), ("and", " AND "), ("with", " WITH "), ("orlater", "-or-later"))
AFTER = ("see", "which", "that", "you", "in", "as", "at", "for", "from", "by", "file", "found", "copyright", "style", "please", "details", "unless", "if", "whose")
#: Words that a line may begin with although it goes on with the sentence of the line before.
GOES_ON = r"[a-z(]|GNU |General Public |Public Licen[sc]e|Lesser General |Affero General |Free Software Foundation|Software Foundation|Foundation[,; ]|Licen[sc]e[,;. ]|Apache Licen[sc]e|Mozilla Public "


def plain(s: str) -> str:
    """A name as it is in a normalised sentence, without fillers."""
    s = re.sub(FILLERS, " ", re.sub(LATER, " ", re.sub("[^a-z0-9.]+", " ", s.lower())))
    return " ".join(s.split())


def names() -> dict[str, str]:
    """Plain names and the licences that they stand for: each family with its versions, whose last zero may be left out,
    and without, and each single licence, under all that they are called."""
    out = {}
    families = [(n, (n, *others), versions) for n, others, versions in FAMILIES]
    words = dict(CC_PARTS)
    for kind in CC_KINDS:
        parts = kind.split("-")
        families.append((f"CC-{kind.upper()}", (f"cc {kind}", "creative commons " + " ".join(words[p] for p in parts), f"creative commons {kind}"), CC_VERSIONS))
    for family, called, versions in families:
        for name in called:
            if name not in NOT_ALONE:
                out.setdefault(plain(name), family)
            for v in versions:
                for shown in {v, v.removesuffix(".0")}:
                    out.setdefault(plain(f"{name} {shown}"), f"{family}-{v}")
    for licence, called in SINGLE:
        for name in (licence, *called):
            out.setdefault(plain(name), licence)
    return out


NAMES = names()
#: What each word or run of words of an expression is written as.
WRITTEN = NAMES | {plain(x): x for x in EXCEPTIONS} | dict(JOINS)


def _any(words: Iterable[str]) -> str:
    """A pattern of any of them, the longest first."""
    return "(?:" + "|".join(re.escape(w).replace("\\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w))) + r")\b"


_NAME = f"{_any(NAMES)}(?: orlater\\b)?(?: with {_any(map(plain, EXCEPTIONS))})?"
#: A name and those joined to it, up to the end or a word that may come after. The loop needs no way back, so Spark's form
#: takes none, which also keeps it from recursing over a long one.
_EXPRESSION = f"^({_NAME}(?: (?:and or|or|and) {_NAME})*%s)(?: {_any(AFTER)}.*)?$"
JAVA_EXPRESSION, SQL_EXPRESSION = _EXPRESSION % "+", _EXPRESSION % ""
TOKEN = f"{_any([*NAMES, *map(plain, EXCEPTIONS)])}|{_any(w for w, _ in JOINS)}"


def _run(identifiers: tuple[str, ...]) -> str:
    return "".join(f"<{x}>" for x in identifiers)


def sentences(text: Column) -> Column:
    """The normalised sentences of a text. A line that goes on in lower case, or with words that stand within licences,
    goes on with the sentence."""
    joined = F.regexp_replace(F.regexp_replace(text, "([0-9])[+]", "$1 or later"), rf"[ \t]*\r?\n[ \t#*/;-]*({GOES_ON})", " $1")
    parts = F.split(F.regexp_replace(joined, r"[.;!?][ \t]+", "\n"), r"[\r\n]+")
    clean = lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9.]+", " ")), r"^[. ]+|[. ]+$", "")
    return F.filter(F.transform(parts, clean), lambda s: s != "")


def named(sentence: Column, begins: str) -> Column:
    """The licences that a sentence which begins so names, as an expression of those joined by AND, OR and WITH in the order
    of the sentence (brackets are not kept), null if the first of them is not known or something unknown is joined to it.
    "or later" is kept, "only" is not."""
    rest = F.regexp_replace(F.regexp_replace(sentence, begins, ""), "([ a-z])v ?([0-9])", "$1 $2")
    rest = F.regexp_replace(F.regexp_replace(rest, rf"\b{LATER}\b", "orlater"), FILLERS, " ")
    whole = F.regexp_extract(F.trim(F.regexp_replace(rest, " +", " ")), JAVA_EXPRESSION, 1)
    table = F.create_map(*(F.lit(x) for pair in WRITTEN.items() for x in pair))
    words = F.transform(F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0)), lambda w: F.try_element_at(table, w))
    return F.nullif(F.array_join(words, ""), F.lit(""))


def worth(sentence: Column) -> Column:
    """Whether any of the patterns may fit, by one search for all that begin with set words and by what the others hold;
    nearly every sentence ends here."""
    open_start = "^" + _ANY
    begun = [p.removeprefix("^") for p in (NAMES_IT, TAG, *(p for _, p in SENTENCES if not p.startswith(open_start)))]
    held = {re.match("[a-z ]+", p.removeprefix(open_start)).group() for _, p in SENTENCES if p.startswith(open_start)}
    return reduce(Column.__or__, (F.contains(sentence, F.lit(x)) for x in sorted(held)), sentence.rlike("^(?:" + "|".join(begun) + ")"))


def identifier(sentence: Column) -> Column:
    """Of a normalised sentence, null if it is not known."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(pattern), F.lit(name)).otherwise(out)
    out = F.when(sentence.rlike(TAG), F.concat(F.lit("tag:"), named(sentence, TAG))).otherwise(out)
    out = F.when(sentence.rlike(NAMES_IT), F.concat(F.lit("ref:"), named(sentence, NAMES_IT))).otherwise(out)
    return F.when(worth(sentence), out)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sequence, the identifiers of its licence sentences in order as <A><B>, and licenses, comma-joined: the
    names that rules find in it, by the order of the rules, then those that are named in what is left, in their order;
    both empty where there are none, as for a null text. Columns of these names are replaced. Nothing is shuffled."""
    full = F.coalesce(F.col(text), F.lit(""))
    known = F.array_compact(F.transform(sentences(full), identifier))
    shown = F.array_join(F.transform(known, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")
    kept = [c for c in docs.columns if c not in ("sequence", "licenses")]
    marked = docs.select(*kept, shown.alias("sequence"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["run"])
        return F.struct(
            F.replace(state["left"], rule["run"], F.lit("-")).alias("left"),
            F.when(hit, F.concat(state["names"], F.array(rule["name"]))).otherwise(state["names"]).alias("names"),
        )

    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(_run(ids)).alias("run")) for n, ids in RULES))
    start = F.struct(F.col("sequence").alias("left"), F.array().cast("array<string>").alias("names"))
    end = lambda state: F.concat(state["names"], F.regexp_extract_all(state["left"], F.lit("<(?:ref|tag):([^>]+)>"), F.lit(1)))
    found = F.array_join(F.array_distinct(F.aggregate(rules, start, step, end)), ",")
    return marked.withColumn("licenses", F.when(F.col("sequence") != "", found).otherwise(""))


def duckdb_sql() -> str:
    """The same over the documents table in DuckDB SQL, from the same fixed values."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    later = quoted(rf"\b{LATER}\b")
    bare = lambda begins: rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, {quoted(begins)}, ''), '([ a-z])v ?([0-9])', '\1 \2', 'g'), {later}, 'orlater', 'g'), {quoted(FILLERS)}, ' ', 'g'), ' +', ' ', 'g'))"
    table = "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in WRITTEN.items()) + "}"
    words = lambda begins: f"regexp_extract_all(regexp_extract({bare(begins)}, {quoted(SQL_EXPRESSION)}, 1), {quoted(TOKEN)})"
    look = lambda kind, begins: f"WHEN regexp_matches(s, {quoted(begins)}) THEN '{kind}:' || nullif(array_to_string(list_transform({words(begins)}, lambda w: map_extract(t, w)[1]), ''), '')"
    case = f"CASE {look('ref', NAMES_IT)} {look('tag', TAG)} " + " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN {quoted(n)}" for n, p in SENTENCES) + " END"
    left, tests = "sequence", []
    for name, ids in RULES:
        tests.append(f"CASE WHEN contains({left}, {quoted(_run(ids))}) THEN {quoted(name)} END")
        left = f"replace({left}, {quoted(_run(ids))}, '-')"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
 j AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([0-9])[+]', '\1 or later', 'g'), '[ \t]*\r?\n[ \t#*/;-]*({GOES_ON})', ' \1', 'g'), '[.;!?][ \t]+', chr(10), 'g') AS t FROM d),
 l AS (SELECT doc_id, list_transform(regexp_split_to_array(t, '[\r\n]+'), lambda x: regexp_replace(trim(regexp_replace(lower(x), '[^a-z0-9.]+', ' ', 'g')), '^[. ]+|[. ]+$', '', 'g')) AS s FROM j),
 u AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM l),
 n AS (SELECT {table} AS t),
 c AS (SELECT doc_id, k, {case} AS i FROM u, n),
 i AS (SELECT doc_id, string_agg('<' || i || '>', '' ORDER BY k) AS sequence FROM c WHERE i IS NOT NULL GROUP BY doc_id),
 r AS (SELECT d.doc_id, coalesce(sequence, '') AS sequence FROM d LEFT JOIN i USING (doc_id)),
 f AS (SELECT doc_id, sequence, list_concat(list_filter([{", ".join(tests)}], lambda x: x IS NOT NULL), regexp_extract_all({left}, '<(?:ref|tag):([^>]+)>', 1)) AS found FROM r)
SELECT doc_id, sequence, array_to_string(list_filter(found, lambda x, k: list_position(found, x) = k), ',') AS licenses FROM f"""
