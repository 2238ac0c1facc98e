"""URL filter, licence scan and fingerprints: against SQL and brute force, and their plans hold no Python."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fernweave.llm import common, fingerprints, licenses, queries, urlfilter

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op3_url_filter", "op6_license_scan", "op8_decontaminate"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*cols).collect())))
    want = sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()))
    assert got == want


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_urls_as_sql_with_a_list(spark, sf):
    sf = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    df = queries.QUERIES["op3_url_filter"](spark, sf)
    cols = sorted(df.columns)
    rows = df.select(*cols).collect()
    assert 0 < sum(r.listed for r in rows) < len(rows) / 4
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL['op3_url_filter']})").fetchall()))
    assert "BloomFilter" not in plan(df) and plan(df).count("Join") == 2


@pytest.mark.parametrize("name", ["op2_fingerprints", "op3_url_filter", "op6_license_scan"])
def test_no_python_in_the_plan(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


URLS = [None, "", "no-scheme/x", "http://A.NET/x", "http://a.net", "https://example.net/en/1?q", "http://www.example.com/de", "http://www.example.com/de/", "http://example.com/dean", "http://example.com/de/1#x", "http://net/", "http://xexample.com/de", "ftp://b.org/fr/x#y", "http://b.org/fr", "http://x://y/z", "http://q.io/a/", "http://q.io/a?u=1", "http://q.io/\n/a"]


# The contract's four rules, written out here once more: the test must not take them from the code.
CONTRACT = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow", False
    rest = url.split("://", 1)[1]
    cut = lambda s, signs: s[: min([s.find(c) for c in signs if c in s], default=len(s))]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in CONTRACT if (host == h or host.endswith("." + h)) and path.startswith(p)]
    inside = host != "" and host + path.rstrip("/") in listed
    if fit:
        _, rule, verdict = max(fit)
        return host, path, rule, verdict, inside
    return host, path, None, "block" if inside else "allow", inside


@pytest.mark.parametrize("size", [1 << 20, 2500, 0])
def test_urls_by_hand(spark, monkeypatch, size):
    monkeypatch.setattr(common, "BROADCAST_BYTES", size)
    d = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, "http://q.io/a/", "x")], "page_id long, url string, host string")
    keys = ["q.io/a", "a.net/x"] + [f"other{i}.io/p" for i in range(500)]
    listed = spark.createDataFrame([(k,) for k in keys], "url_key string")
    got = sorted(map(repr, map(tuple, urlfilter.judge_urls(d, listed).collect())))
    want = sorted(repr((i, *brute(u, set(keys)))) for i, u in [*enumerate(URLS), (3, URLS[3]), (None, "http://q.io/a/")])
    assert got == want
    none = listed.filter(F.lit(False))
    assert urlfilter.judge_urls(d, none).filter("listed").count() == 0 and urlfilter.judge_urls(d.filter(F.lit(False)), listed).count() == 0


def test_no_listed_url_is_lost_and_few_others_pass(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".io/")).alias("url_key"))
    blocks = 300
    bloom = urlfilter.bloom_blocks(keys, blocks)
    probe = lambda k: k.withColumn("block", F.pmod(F.xxhash64("url_key"), F.lit(blocks))).join(bloom, "block").filter(urlfilter._maybe(F.col("url_key"))).count()
    assert probe(keys) == 3000
    assert probe(spark.range(20000).select(F.concat(F.lit("z"), F.col("id")).alias("url_key"))) < 200


def test_licences_in_order(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows = [(1, mit), (2, mit.split(" The above")[0] + " Other text. All rights reserved."), (3, "Licensed under the Apache License, Version 2.0. Hello."), (4, None), (5, ""), (6, "Released under the MIT License.\nReleased under the MIT License."), (7, "plain")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit("x"))
    got = {r.doc_id: (r.licenses, r.unmatched, r.n_known) for r in licenses.license_scan(d).collect()}
    assert got == {1: ("MIT", "", 2), 2: ("MIT-incomplete,Proprietary", "", 2), 3: ("Apache-2.0", "", 1), 4: ("", "", 0), 5: ("", "", 0), 6: ("MIT", "", 2), 7: ("", "", 0)}
    assert licenses.license_scan(d.filter(F.lit(False))).count() == 0


WRAPPED_TEXTS = {
    "MIT": """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

 * Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "GPL-3.0-or-later": """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0',
}


WRAPPED_TEXTS |= {
    "LGPL-2.1-or-later": """# This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.
#
# This library is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
# Lesser General Public License for more details.""",
    "AGPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU Affero General Public License as published
    by the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    You should have received a copy of the GNU Affero General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.""",
    "Unlicense": """// This is free and unencumbered software released into the public domain.
//
// Anyone is free to copy, modify, publish, use, compile, sell, or
// distribute this software, either in source code form or as a compiled
// binary, for any purpose, commercial or non-commercial, and by any
// means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment would be appreciated but is not required.""",
    "GPL-2.0-only": "// SPDX-License-Identifier: GPL-2.0-only",
    "EPL-2.0": "/* This program and the accompanying materials are made available under the\n * terms of the Eclipse Public License 2.0 which is available at\n * https://www.eclipse.org/legal/epl-2.0/\n */",
}


def test_licences_as_published(spark):
    rows = [(name, t) for name, t in WRAPPED_TEXTS.items()] + [(name, t.replace("\n", "\r\n")) for name, t in WRAPPED_TEXTS.items()]
    rows += [("MPL-2.0", WRAPPED_TEXTS["MPL-2.0"].replace("\n", " ")), ("MIT-incomplete,Proprietary", "All rights reserved\n" + WRAPPED_TEXTS["MIT"].split("\n\n")[1]), ("", "released under\n\nthe mit license"), ("", "\x01\x02MIT\x01\n;<Mpl2>")]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert [(r.doc_id, r.unmatched) for r in got] == [(r.licenses, "") for r in got]
    assert [r.n_known for r in got if r.doc_id == "Apache-2.0"] == [3, 3] and [r.n_known for r in got if r.doc_id == "MIT"] == [4, 4]


def test_licence_rows_that_repeat_or_have_no_id(spark):
    rows = [(1, "All rights reserved"), (1, "All rights reserved"), (None, "Released under the MIT License."), (None, None), (2, "x " * 300_000 + "\nLicensed under CC0 1.0")]
    got = sorted(((r.doc_id or 0, r.licenses) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_names", F.lit(1))).collect()))
    assert got == [(0, ""), (0, "MIT"), (1, "Proprietary"), (1, "Proprietary"), (2, "CC0-1.0")]


def pieces(t):
    import re

    return {x for x in re.split(r"\n|(?<=[.!?])\s+", t) if x}


def alike(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


@pytest.mark.parametrize("bucket_rows", [3, 512])
def test_fingerprints_by_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket_rows)
    texts = ["", None, "one line", "\n".join(f"line {i}" for i in range(400)), "\n".join(f"line {i}" for i in range(5, 400)), "É漢🙂\nzwei. drei", "one line", "\n\n", "a\nb\na"]
    rows = [(i * 7 - 11, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1))
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(d).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.near_edited == pytest.approx(alike(pieces(t), pieces(e))) and r.near_next == pytest.approx(alike(pieces(t), pieces(n)))
    same = [got[i].fingerprint for i, t in rows if t == "one line"]
    assert same[0] == same[1]


@pytest.mark.parametrize("bucket_rows", [1, 2, 4, 512])
def test_next_rows_by_sorting(spark, monkeypatch, bucket_rows):
    """Ids of texts and of numbers, repeated, missing, and one that a third of the rows have, in many small buckets."""
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket_rows)
    ids = [f"k{i:02d}" for i in range(25)] + ["hot"] * 20 + [None] * 10 + ["k03"] * 3
    for kind, make in (("string", lambda x: x), ("bigint", lambda x: None if x is None else -5 if x == "hot" else int(x[1:]))):
        rows = [(make(x), f"text {k}. two" if k % 4 else "same") for k, x in enumerate(ids)]
        d = spark.createDataFrame(rows, f"doc_id {kind}, text string")
        hashes = {r.text: r.h for r in d.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
        order = sorted([r for r in rows if r[0] is not None], key=lambda r: hashes[r[1]])
        order = sorted(order, key=lambda r: r[0], reverse=True) + sorted([r for r in rows if r[0] is None], key=lambda r: hashes[r[1]])
        want = sorted([(*r, order[(k + 1) % len(order)][1]) for k, r in enumerate(order)], key=str)
        got = sorted([(r._id, r._text, r.next_text) for r in fingerprints.with_next(d, "doc_id", {}).collect()], key=str)
        assert got == want
    assert fingerprints.fingerprint_edits(d.select(F.col("doc_id").cast("string"), "text")).count() == len(ids)


def test_fingerprints_of_odd_tables(spark):
    d = spark.createDataFrame([(5, "a\nb")], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(d).first().near_next == 1.0
    assert fingerprints.fingerprint_edits(d.filter(F.lit(False))).count() == 0
    odd = spark.createDataFrame([(None, "x"), (None, "y"), (1, "z"), (1, "z")], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(odd).count() == 4
    assert fingerprints.fingerprint_edits(odd.filter("doc_id IS NULL")).count() == 2
