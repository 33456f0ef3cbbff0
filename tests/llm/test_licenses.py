import math
import re
from collections import Counter

import pytest

from plumbline.llm import licenses as lc

from .rows import documents


def brute(files, threshold=lc.THRESHOLD):
    """{(path, text): (licence, score, found, dir)} by dense comparison of every unit and template."""
    words = lambda t: Counter(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower()))
    units = {}
    for path, text in files:
        lines = (text or "").split("\n")
        for i, line in enumerate(lines):
            if re.search(lc.CUE, line):
                units |= {(path, text, (i, k)): " ".join(lines[i : i + k]) for k in (1, 2, 3) if i + k <= len(lines) and (k == 1 or len(" ".join(lines[i : i + k])) <= lc.NOTICE_CHARS)}
                if ids := [x for x in re.findall("[A-Za-z0-9][A-Za-z0-9.+-]*", (re.search(lc.SPDX, line) or ["", ""])[1]) if x not in ("AND", "OR", "WITH")]:
                    units[path, text, (i, 0)] = " ".join("spdx-" + x for x in ids)
        if path and text and re.search(lc.LICENCE_FILE, path.split("/")[-1]):
            units[path, text, -1] = text
    tf = {k: words(t) for k, t in units.items()}
    patterns = [(i, words(t)) for i, t in lc.TEMPLATES]
    df = Counter(w for c in [*tf.values(), *(c for _, c in patterns)] for w in c)
    idf = {w: math.log((1 + len(tf) + len(patterns)) / (1 + n)) + 1 for w, n in df.items()}
    norm = lambda c: math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
    own, of_dir = {}, {}
    for (path, text, i), c in tf.items():
        for licence, p in patterns:
            dot = sum(n * p[w] * idf[w] ** 2 for w, n in c.items() if w in p)
            if dot and (s := round(dot / norm(c) / norm(p), 9)) >= threshold:
                own[path, text] = min(own.get((path, text), (True, 0, "~")), (i != -1 or s < lc.VERBATIM, -s, licence))
    own = {k: v[1:] for k, v in own.items()}
    for (path, text, i) in units:
        if i == -1 and (path, text) in own:
            d = path.rpartition("/")[0]
            of_dir[d] = min(of_dir.get(d, (0, "~")), own[path, text])
    out = {}
    for path, text in files:
        if (path, text) in own:
            out[path, text] = (own[path, text][1], -own[path, text][0], "own", None)
            continue
        out[path, text] = (None, None, None, None)
        d = path.rpartition("/")[0] if path is not None else None
        while d is not None:
            if d in of_dir:
                out[path, text] = (of_dir[d][1], -of_dir[d][0], "inherited", d)
                break
            d = None if d == "" else d.rpartition("/")[0]
    return out


def same(spark, files):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files)], "id long, path string, text string").selectExpr("*", "1 AS token", "'x' AS unit")
    want, got = brute(files), lc.scan(df, lc.templates(spark)).collect()
    assert len(got) == len(files)
    for r in got:
        w = want[files[r.id]]
        assert (r.license_id, r.found, r.licence_dir) == (w[0], w[2], w[3]), files[r.id]
        assert r.score == (None if w[1] is None else pytest.approx(w[1], abs=1e-8))
    return got


def test_equals_brute_force(spark, sf):
    rows = [
        ("LICENSE", "Released under the MIT License."), ("a/LICENSE.txt", "Licensed under the Apache License, Version 2.0."), ("a/b/c/x.py", "no cue"),
        ("a/x.py", "# Licensed under CC BY-NC 4.0.\nprint(1)"), ("z/y/x", None), ("z/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("z/LICENSE-MIT", "Released under the MIT License."), ("z/y/x", None), (None, "Released under the MIT License."), (None, "nothing"), ("top", ""), ("", ""),
        ("s/a.c", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;"), ("s/b.c", "// SPDX-License-Identifier: (MIT OR Apache-2.0)"), ("s/c.c", "# SPDX-License-Identifier: Unheard-1.0"), ("s/d.c", "SPDX-License-Identifier:"),
        ("n/LICENSE", "Apache License\nVersion 2.0, January 2004\n\n" + "You must give any other recipients of the Work a copy of this license\n" * 9), ("n/x.go", "// governed by a BSD-style\n// license that can be found in the LICENSE file."),
        ("a/b/NOTICE", "some license of no known kind at all but long prose about things"), ("abc/x", "permission " * 5000), ("a", "x"),
    ]
    got = same(spark, rows)
    assert {r.found for r in got} == {"own", "inherited", None}
    docs = spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in documents(sf)], "doc_id long, text string, source string")
    files = [(r.path, r.text) for r in lc.files_of_documents(docs).collect()]
    same(spark, files)


def test_empty(spark):
    df = spark.createDataFrame([], "id long, path string, text string")
    assert lc.scan(df, lc.templates(spark)).count() == 0
    some = spark.createDataFrame([(1, "a", "license")], "id long, path string, text string")
    assert lc.scan(some, lc.templates(spark).limit(0)).collect()[0].license_id is None


@pytest.mark.parametrize("licence, text", [*lc.WHOLE, ("Apache-2.0", "// Copyright 2020 The Authors. All rights reserved. Licensed under the Apache License, Version 2.0.")])
def test_whole_licences_are_found(spark, licence, text):
    files = spark.createDataFrame([(1, "a/LICENSE", "Copyright (c) 2021 Some One\n\n" + text), (2, "a/b.py", "x = 1")], "id long, path string, text string")
    got = {r.id: (r.license_id, r.found, r.score) for r in lc.scan(files, lc.templates(spark)).collect()}
    assert got[1][:2] == (licence, "own") and got[1][2] >= (0.85 if "\n" in text else lc.THRESHOLD) and got[2][:2] == (licence, "inherited")


BODY = "Each contributor grants recipients a copyright license. Redistributions of the work in source or binary form, with or without modification, are permitted under the conditions of this license.\n"


@pytest.mark.parametrize("licence, title", [
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n"), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n"), ("EPL-2.0", "Eclipse Public License - v 2.0\n"),
])
def test_long_licences_are_found_by_their_titles(spark, licence, title):
    """Their bodies are no templates, and share much with licences that are."""
    disclaimer = " ".join(lc.WHOLE[3][1].split()[60:140])
    files = spark.createDataFrame([(1, "a/LICENSE", title + "\n" + BODY * 20 + disclaimer), (2, "a/b.py", "x = 1"), (3, "c/LICENSE", BODY * 3)], "id long, path string, text string")
    got = {r.id: (r.license_id, r.found) for r in lc.scan(files, lc.templates(spark)).collect()}
    assert got[1] == (licence, "own") and got[2] == (licence, "inherited") and got[3][1] != "inherited"


def test_spdx_ids(spark):
    texts = {"/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0", "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "# SPDX-License-Identifier: Unheard-9.9": None}
    files = spark.createDataFrame([(i, f"d{i}/x.c", t + "\ncode();") for i, t in enumerate(texts)], "id long, path string, text string")
    got = {r.id: r.license_id for r in lc.scan(files, lc.templates(spark)).collect()}
    assert got == dict(enumerate(texts.values()))
