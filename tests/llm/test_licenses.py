import pytest

from corpusflow.llm import licenses

MIT = """/* Copyright (c) 2020 Someone
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software, and to permit persons to whom the Software is
 * furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all
 * copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
 * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
 * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. */"""


@pytest.mark.parametrize("text, names, left", [
    ("Some prose.\nReleased under the MIT License.", "MIT", 0),
    ("PROSE!!\nLICENSED!! UNDER!! THE!! APACHE!! LICENSE,!! VERSION!! 2.0.", "Apache-2.0", 0),
    ("Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", "CC-BY-NC-4.0,MIT", 0),
    (MIT, "MIT", 1),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", "GPL-3.0-or-later", 0),
    ("This program is free software. Nothing more.", "", 1),
    ("Driving licence needed here", "", 1),
    ("plain words only", "", 0), ("", "", 0), (None, "", 0),
    ("x " * 50_000 + "\nAll rights reserved.", "Proprietary", 0),
])
def test_rules(spark, text, names, left):
    df = spark.createDataFrame([(1, text, "x")], "doc_id long, text string, licenses string")
    r = licenses.scan(df).first()
    assert (r.licenses, r.n_left, r.n_licenses) == (names, left, len(names.split(",")) if names else 0)


GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""

BSD3 = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//
//    * Redistributions of source code must retain the above copyright
// notice, this list of conditions and the following disclaimer.
//    * Redistributions in binary form must reproduce the above
// copyright notice, this list of conditions and the following disclaimer
// in the documentation and/or other materials provided with the
// distribution.
//    * Neither the name of Google Inc. nor the names of its
// contributors may be used to endorse or promote products derived from
// this software without specific prior written permission."""


@pytest.mark.parametrize("text, names, left", [
    (GPL3, "GPL-3.0-or-later", 0), (GPL3.replace("This program", "Foo").replace("version 3", "version 2"), "GPL-2.0-or-later", 0),
    (BSD3, "BSD-3-Clause", 0), (BSD3.replace("Google Inc.", "the copyright holder"), "BSD-3-Clause", 0), (BSD3.split("//    * Neither")[0], "BSD-2-Clause", 0),
    ("This file is licensed under the MIT License.", "MIT", 0), ("Foo is released under the MIT licence.", "MIT", 0),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT", 0),
    ("This file is not licensed under the MIT License.", "", 1), ("No part of it is licensed under the MIT License.", "", 1),
    ("// SPDX-License-Identifier: MIT\nint x;", "MIT", 0), ("/* SPDX-License-Identifier: GPL-2.0+ */", "GPL-2.0-or-later", 0),
    ("# SPDX-License-Identifier: (GPL-3.0-or-later OR BSD-3-Clause) AND Apache-2.0", "Apache-2.0,BSD-3-Clause,GPL-3.0-or-later", 0),
    ("# SPDX-License-Identifier: Foo-1.0", "", 1),
    ("All rights\nreserved.", "Proprietary", 0),
])
def test_published_notices(spark, text, names, left):
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.licenses, r.n_left) == (names, left)


def test_variants_name_known_identifiers():
    assert {i for v in licenses.VARIANTS.values() for i in v.split(";")} <= set(licenses.SENTENCES.values())


def test_tables(spark):
    df = spark.createDataFrame([(1, "All rights reserved"), (1, "All rights reserved"), (None, "All rights reserved")], "doc_id long, text string")
    assert [r.licenses for r in licenses.scan(df).collect()] == ["Proprietary"] * 3
    assert licenses.scan(df.limit(0)).count() == 0
    plan = licenses.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_name_known_identifiers():
    known = set(licenses.SENTENCES.values())
    import re
    for _, rule in licenses.RULES:
        assert set(re.findall(r"[a-z0-9]+", rule)) <= known


LGPL = """/* This library is free software; you can redistribute it and/or
   modify it under the terms of the GNU Lesser General Public
   License as published by the Free Software Foundation; either
   version 2.1 of the License, or (at your option) any later version. */"""
ISC = """Copyright (c) 2021, Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     https://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
MORE = [
    (LGPL, "LGPL-2.1-or-later", 0), (LGPL.replace("version 2.1", "version 3").replace("Foundation; either", "Foundation, either"), "LGPL-3.0-or-later", 0),
    (LGPL.replace("Lesser", "Affero").replace("2.1", "3"), "AGPL-3.0-or-later", 0), (ISC, "ISC", 1), (APACHE, "Apache-2.0", 0), (APACHE.replace(" *", "#"), "Apache-2.0", 0),
    (UNLICENSE, "Unlicense", 0), (ZLIB, "Zlib", 0), ("// SPDX-License-Identifier: ISC", "ISC", 0), ("SPDX-License-Identifier: LGPL-2.1+ OR EPL-2.0", "EPL-2.0,LGPL-2.1-or-later", 0),
    ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0", 0),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution", "EPL-2.0", 0),
    ("Copyright 2020 X. All rights reserved.\n\n" + BSD3, "BSD-3-Clause", 1), ("All rights reserved.\n\nLicensed under CC0 1.0.", "CC0-1.0", 0),
    (BSD3.replace("Google Inc.", "the Very Long Name of an Organisation " * 12), "BSD-3-Clause", 0),
]


@pytest.mark.parametrize("text, names, left", MORE)
def test_more_published_notices(spark, text, names, left):
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.licenses, r.n_left) == (names, left), r.sequence


def test_the_sql_states_the_same_rules(spark):
    """Every notice by itself, below prose, and two together, in Spark and by the SQL."""
    import duckdb

    from corpusflow.llm.sql import OP4
    notices = [MIT, GPL3, BSD3, *[t for t, _, _ in MORE], "This file is licensed under the MIT License.", "Foo is released under the MIT licence.",
               "No part of it is licensed under the MIT License.", "# SPDX-License-Identifier: (GPL-3.0-or-later OR BSD-3-Clause) AND Apache-2.0",
               "/* SPDX-License-Identifier: GPL-2.0+ */", "All rights\nreserved.", "Some permission, or a licence; unknown: text.\r\nMore licence", "", None]
    rows = list(enumerate(notices + [f"Some prose. And more.\n\n{t}" for t in notices] + [f"{t}\n{u}" for t, u in zip(notices, notices[1:])]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    out = con.execute(OP4)
    columns = [d[0] for d in out.description]
    want = {r[columns.index("doc_id")]: dict(zip(columns, r)) for r in out.fetchall()}
    got = {r.doc_id: r.asDict() for r in licenses.scan(df).collect()}
    assert got == want and sum(r["n_licenses"] > 0 for r in got.values()) > 60
