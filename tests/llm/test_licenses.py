"""Known notices, whole licence headers, and the query against its SQL."""

import duckdb

from plumbline.llm import licenses
from plumbline.llm.queries import QUERIES, SQL

APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at https://example.org/x
"""
BSD = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that:
1. Redistributions of source code must retain the above copyright notice, this list.
2. Redistributions in binary form must reproduce the above copyright notice, this list.
"""
GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://example.org/MPL/2.0/.
"""
CASES = [
    (GPL2, "<FreeSoftware><GplModify><Either2><GplHope>", "GPL-2.0"), (GPL3, "<GplOne3>", "GPL-3.0"), (GPL3.replace("GNU General", "GNU Affero General"), "<AgplOne3>", "AGPL-3.0"),
    (GPL2.replace("\nit under the terms of the GNU General", " it under the terms of the\nGNU Lesser General").replace("version 2", "version 2.1"), "<FreeSoftware><LgplModify><Either21><GplHope>", "LGPL-2.1"),
    (MPL, "<MplForm><Two><MplCopy>", "MPL-2.0"), ("Released under the 3-clause BSD license", "<ref:BSD-3-Clause>", "BSD-3-Clause"),
    ("Released under the GPLv3 or later", "<ref:GPL-3.0-or-later>", "GPL-3.0-or-later"), ("License: EPL-2.0\nSPDX-License-Identifier: LGPL-2.1-or-later", "<tag:EPL-2.0><tag:LGPL-2.1-or-later>", "EPL-2.0,LGPL-2.1-or-later"),
    ("Licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "<ref:CC-BY-SA-3.0>", "CC-BY-SA-3.0"), ("Licensed under the rule of thumb.", "", ""),
    ("Licensed under CC BY-NC 4.0.\nwords", "<ref:CC-BY-NC-4.0>", "CC-BY-NC-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "<ref:GPL-3.0>", "GPL-3.0"),
    ("a. Licensed under the Apache License, Version 2.0. b\nReleased under the MIT License.", "<ref:Apache-2.0><ref:MIT>", "Apache-2.0,MIT"),
    (APACHE, "<ref:Apache-2.0><ApacheComply><ApacheCopy>", "Apache-2.0"), (BSD, "<BsdUse><BsdSource><BsdBinary>", "BSD-2-Clause"),
    (BSD + "3. Neither the name of the owner nor its contributors may be used to endorse or promote products.", "<BsdUse><BsdSource><BsdBinary><BsdEndorse>", "BSD-3-Clause"),
    ("SPDX-License-Identifier: MIT", "<tag:MIT>", "MIT"), ("My license is great. the MIT License", "", ""), ("", "", ""), (None, "", ""),
    ("x " * 60_000 + ".\nReleased under the MIT License. " * 50, "<ref:MIT>" * 50, "MIT"),
]

#: Sentences that name several licences, exceptions, later versions or a program, with what a reader takes from them.
EXPRESSIONS = [
    ("Dual licensed under MIT or Apache-2.0.", "MIT OR Apache-2.0"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"), ("// SPDX-License-Identifier: (GPL-2.0-only OR BSD-2-Clause)", "GPL-2.0 OR BSD-2-Clause"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0 WITH Classpath-exception-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later WITH GCC-exception-3.1 AND MIT", "GPL-2.0-or-later WITH GCC-exception-3.1 AND MIT"),
    ("This code is licensed under the MIT license, see LICENSE.", "MIT"), ("Licensed under the Apache License v2.0 and the MIT license.", "Apache-2.0 AND MIT"),
    ("Use of this source code is governed by a BSD-style license that can be\nfound in the LICENSE file.", "BSD"), ("Licensed under either the MIT license or the Apache License, Version 2.0", "MIT OR Apache-2.0"),
    ("Licensed under the GPLv2+", "GPL-2.0-or-later"), ("Released under the LGPL v2.1 or (at your option) any later version.", "LGPL-2.1-or-later"), ("Released under the MIT and/or ISC license", "MIT OR ISC"),
    (GPL3.replace("This program", "Foo"), "GPL-3.0"), (GPL2.replace("This program", "Foo Bar 2"), "GPL-2.0"), ("Released under MIT" + " or MIT" * 20_000, "MIT" + " OR MIT" * 20_000),
    ("Licensed under MIT or a secret licence of our own.", ""), ("Released under an open license.", ""), ("Licensed under the Open Software License version 3.0", "OSL-3.0"), ("Released under MITRE rules", ""), ("Released under the MIT 3000", ""),
]


def test_expressions(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in EXPRESSIONS)), "doc_id int, text string")
    got = {r.doc_id: r.licenses for r in licenses.scan(df).collect()}
    assert {t[:60]: got[k][:60] for k, (t, _) in enumerate(EXPRESSIONS)} == {t[:60]: x[:60] for t, x in EXPRESSIONS}
    assert all(got[k] == x for k, (_, x) in enumerate(EXPRESSIONS))


def test_cases(spark):
    df = spark.createDataFrame([(k, t, "old") for k, (t, _, _) in enumerate(CASES)] + [(None, CASES[0][0], "old")] * 2, "doc_id int, text string, licenses string")
    got = [(r.doc_id, r.sequence, r.licenses) for r in licenses.scan(df).collect()]
    want = [(k, s, x) for k, (_, s, x) in enumerate(CASES)] + [(None, *CASES[0][1:])] * 2
    assert sorted(got, key=str) == sorted(want, key=str)
    assert licenses.scan(df.limit(0)).collect() == []


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    got = sorted(tuple(r) for r in QUERIES["op2_license_scan"](spark, "/root/testdata/sf0.01").select("doc_id", "sequence", "licenses").collect())
    assert got == sorted(con.execute(SQL["op2_license_scan"]).fetchall()) and any(r[2] for r in got)
    # the documents hold few forms: the SQL must know the others too
    texts = [t for t, _, _ in CASES[:-1]] + list(ALONE.values()) + [t for t, _ in EXPRESSIONS] + [f"Released under {n}, version" for n in licenses.NAMES]
    con.execute("DROP VIEW documents; CREATE TABLE documents (doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r.doc_id, r.sequence, r.licenses) for r in licenses.scan(df).collect())
    assert got == sorted(con.execute(SQL["op2_license_scan"]).fetchall())


#: A text of one sentence for each identifier, with none of the words of others around it.
ALONE = {
    "ApacheComply": "You may not use this file except in compliance with the License.",
    "ApacheCopy": "You may obtain a copy of the License at https", "ApacheAsIs": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS',
    "BoostPermission": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy", "MitPermission": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "MitNotice": "The above copyright notice and this permission notice shall be included in all copies", "AsIs": 'The software is provided "as is"',
    "IscPermission": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "ZlibPermission": "Permission is granted to anyone to use this software for any purpose, including commercial applications", "ZlibOrigin": "1. The origin of this software must not be misrepresented",
    "ZlibAltered": "2. Altered source versions must be plainly marked as such", "ZlibNotice": "3. This notice may not be removed or altered from any source distribution.",
    "Unencumbered": "This is free and unencumbered software released into the public domain.",
    "AgplOne3": GPL3.replace("GNU", "GNU Affero"), "LgplOne3": GPL3.replace("GNU", "GNU Lesser"), "LgplOne21": GPL3.replace("GNU", "GNU Lesser").replace("version 3", "version 2.1"),
    "GplOne3": GPL3, "GplOne2": GPL3.replace("version 3", "version 2"), "FreeSoftware": "This library is free software.",
    "AgplModify": "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "LgplModify": "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "GplModify": "You can redistribute it and/or modify it under the terms of the GNU General Public License", "Either3": "Either version 3 of the License", "Either21": "Either version 2.1 of the License",
    "Either2": "Either version 2 of the License", "GplHope": "This program is distributed in the hope that it will be useful",
    "BsdUse": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "BsdSource": "Redistributions of source code must retain the above copyright notice", "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice",
    "BsdAdvertise": "All advertising materials mentioning features or use of this software must display", "BsdEndorse": "Neither the name of the owner may be used to endorse or promote products",
    "MplForm": "This Source Code Form is subject to the terms of the Mozilla Public License, v.", "MplForm2": "This Source Code Form is subject to the terms of the Mozilla Public License, v2.0", "Two": "2.0",
    "MplCopy": "If a copy of the MPL was not distributed with this file", "EplMaterials": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "Cc0Waive": "To the extent possible under law, the author has waived all copyright", "Reserved": "All rights reserved.",
}


def test_each_name(spark):
    """Every plain name, in a sentence and in a tag, stands for its licence; there are several hundred."""
    names = list(licenses.NAMES.items())
    assert len(names) > 200 and dict(names)["gpl 3"] == "GPL-3.0" and dict(names)["cc by nc sa 4.0"] == "CC-BY-NC-SA-4.0"
    rows = [(f"Licensed under the {n} license.\nSPDX-License-Identifier: {n}", f"<ref:{x}><tag:{x}>", x) for n, x in names]
    got = licenses.scan(spark.createDataFrame(rows, "text string, s string, l string")).collect()
    assert [(r.text, r.sequence, r.licenses) for r in got if (r.sequence, r.licenses) != (r.s, r.l)] == []


def test_each_sentence_alone(spark):
    assert list(ALONE) == [n for n, _ in licenses.SENTENCES]
    got = licenses.scan(spark.createDataFrame(list(ALONE.items()), "name string, text string")).collect()
    assert {r.name: r.sequence for r in got} == {n: f"<{n}>" for n in ALONE}
