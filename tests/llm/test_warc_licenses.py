import hashlib
import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mosaica.llm import licenses, queries, warc
from mosaica.llm.common import scratch_dir, table
from tests.oracle import assert_same

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op4_warc_derivatives", "op9_licence_scan"])
def test_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE[name], SF)


def test_native(spark, sf):
    files = table(spark, sf, "documents").select("doc_id", F.col("source").alias("path"), "text")
    texts = files.select(F.xxhash64("text").alias("h1"), F.lit(1).alias("h2"), "text")
    plan = licenses.own_licences(texts)._jdf.queryExecution().toString() + queries.op9_licence_scan(spark, sf)._jdf.queryExecution().toString() + warc.derive(warc.responses(table(spark, sf, "pages")))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_warc_files(spark, sf):
    pages = table(spark, sf, "pages")
    made = warc.responses(pages).drop("page_id").unionByName(warc.derive(warc.responses(pages)).drop("page_id"))
    path = scratch_dir(spark)
    warc.write_warc(made, path)
    back = warc.read_warc(spark, path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, made.select(*warc.FIELDS).collect()), key=str)


def test_warc_edges(spark):
    schema = "page_id long, url string, html string, block string, title string"
    rows = [(1, "u", None, "x", "t"), (2, None, "", "x", "t"), (None, "u", "<p>a&amp;b <!-- c --><b>d</b><script>x</script><a class=q href=\"/l\">m", "x", "t"), (3, "u", "<p" * 30000, "x", "t"), (4, "v", "same", "x", "t"), (4, "v", "same", "x", "t")]
    pages = spark.createDataFrame(rows, schema)
    out = warc.derive(warc.responses(pages)).collect()
    assert len(out) == 2 * len(rows)
    text = {r.page_id: r for r in out if r.record_type == "conversion"}
    assert text[1].block == text[2].block == "" and text[None].block == "a&b dm" and text[3].block == "<p" * 30000
    assert text[None].block_digest == "sha256:" + hashlib.sha256(b"a&b dm").hexdigest()
    assert "outlink: /l\r\n" in next(r.block for r in out if r.page_id is None and r.record_type == "metadata")
    assert all(r.refers_to and r.refers_to != r.record_id for r in out)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


MIT_FILE = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + licenses.TEXTS["MIT"][0].removeprefix("MIT License Copyright ")
APACHE_HEADER = "/*\n * Copyright 2021 The Authors\n *\n" + "".join(f" * {line}\n" for line in licenses.TEXTS["Apache-2.0"][0].split(". ")) + " */\nint main() { return 0; }\n\nint other() { return 1; }\n"


def test_unclosed_markup_takes_linear_time(spark):
    """Twice as many elements that never close take about twice as long, not four times."""
    took = []
    for n in (20_000, 40_000):
        pages = spark.createDataFrame([(1, "u", "<p>a</p><script>x</script>" + "<script>" * n + "<!--" * n + "<style>" * n + "<p" * n)], "page_id long, url string, html string")
        warc.derive(warc.responses(pages)).collect()
        began = time.perf_counter()
        rows = warc.derive(warc.responses(pages)).collect()
        took.append(time.perf_counter() - began)
        assert next(r.block for r in rows if r.record_type == "conversion") == "a\n" + "<p" * n
    assert took[1] < 3 * took[0] + 1


def test_licence_inheritance(spark):
    rows = [
        ("LICENSE", MIT_FILE), ("a/x.py", "code"), ("a/b/COPYING", "x\n\nThis work is licensed under the GNU General Public License, version 3.\n"), ("a/b/c/y.py", None),
        ("a/b/c/z.py", "# Licensed under the Apache License, Version 2.0\n\n" + "word " * 20000), ("ab/q.py", "a licence of some kind"), (None, ""), ("a/x.py", "code"),
        ("d/notice of mine", "Licensed under CC BY-NC 4.0."), ("d/e/f", "text"), ("d/long.txt", "Released under the MIT License.\n\n" + "plain prose goes on here " * 30),
    ]
    files = spark.createDataFrame([(p, t, "clash", "mine", "mine", "mine") for p, t in rows], "path string, text string, licence string, _dir string, _own string, dir string")
    out = licenses.scan(files)
    assert out.columns == ["path", "_dir", "_own", "dir", *licenses.RESULTS] and all(r["_dir"] == r["_own"] == r["dir"] == "mine" for r in out.collect())
    got = sorted((r.path or "", r.own_licence, r.inherited_licence, r.inherited_from) for r in out.collect())
    assert got == [
        ("", None, "MIT", ""),
        ("LICENSE", "MIT", None, None),
        ("a/b/COPYING", "GPL-3.0", None, None),
        ("a/b/c/y.py", None, "GPL-3.0", "a/b"),
        ("a/b/c/z.py", "Apache-2.0", None, None),
        ("a/x.py", None, "MIT", ""),
        ("a/x.py", None, "MIT", ""),
        ("ab/q.py", None, "MIT", ""),
        ("d/e/f", None, "CC-BY-NC-4.0", "d"),
        ("d/long.txt", "MIT", None, None),
        ("d/notice of mine", "CC-BY-NC-4.0", None, None),
    ]
    assert licenses.scan(files.limit(0)).count() == 0


def test_ordinary_wordings(spark):
    """Headers, licence files and statements as people write them, none of them a template."""
    cases = [
        ("MIT", "Licensed under the MIT License"), ("MIT", "This project is licensed under the MIT License - see the LICENSE.md file for details."), ("MIT", MIT_FILE), ("MIT", "// SPDX-License-Identifier: MIT"),
        ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", APACHE_HEADER), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0 */"),
        ("GPL-2.0", "This file is licensed under the GNU General Public License version 2"), ("GPL-3.0", "Licensed under the GNU General Public License v3, version 3"), ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
        ("LGPL-2.1", "Released under the GNU Lesser General Public License, version 2.1"), ("BSD-2-Clause", licenses.TEXTS["BSD-2-Clause"][0].replace("Copyright", "Copyright (c) 2011, Ann Other.")), ("BSD-3-Clause", licenses.TEXTS["BSD-3-Clause"][0].replace("copyright holder", "Example University")),
        ("ISC", licenses.TEXTS["ISC"][0].replace("Copyright", "Copyright (c) 2015 Somebody")), ("MPL-2.0", licenses.TEXTS["MPL-2.0"][0].replace(". ", ".\n// ")), ("CC-BY-SA-4.0", "This text is licensed under CC BY-SA 4.0"), ("Proprietary", "Copyright 2019 Example Inc. All rights reserved."),
        (None, "She released the bird subject to conditions and kept the rights of way"), (None, "the licence of the driver was taken by the police in the morning"), (None, "permission to enter was not given, released or waived"),
    ]
    files = spark.createDataFrame([(f"f{i}/x", t, str(want)) for i, (want, t) in enumerate(cases)], "path string, text string, want string")
    wrong = [(r.path, r.want, r.own_licence, r.own_score) for r in licenses.scan(files).collect() if str(r.own_licence) != r.want]
    assert not wrong


def test_scores_against_dense_cosine(spark):
    """The best passage's score, by plain vectors."""
    idf, rows = licenses.vectors()
    templates = {}
    for i, k, w, x in rows:
        templates.setdefault((i, k), {})[w] = x
    for text in ("Licensed under the Apache License, Version 2.0.", "All rights reserved.", licenses.TEXTS["MIT"][1]):
        n = Counter(re.findall(licenses.WORD, text.lower()))
        v = {w: (1 + math.log(c)) * idf[w] for w, c in n.items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        best = min((-round(sum(x * t.get(w, 0) for w, x in v.items()) / size, 6), k) for (_, k), t in templates.items())
        got = licenses.own_licences(spark.createDataFrame([(1, 2, text)], "h1 long, h2 long, text string")).first()
        assert (got.found, got.score) >= (best[1], -best[0]) and got.score >= -best[0] - 1e-6


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a")], "page_id long, url string, html string")
    names = ("_head", "_body", "_made", "head", "body", "made", "c0")
    out = warc.derive(warc.responses(pages).select("*", *(F.lit("mine").alias(c) for c in names)))
    rows = out.collect()
    assert out.columns[:8] == ["page_id", *names] and len(rows) == 2 and all(r[n] == "mine" for r in rows for n in names)
    assert {r.block for r in rows if r.record_type == "conversion"} == {"a"}


def test_every_wording_is_found(spark):
    """Each template's own text has a cosine of 1 with it, also behind prose and other words that speak of licences."""
    files = [(f"t{i}/x", t, k) for i, (k, t) in enumerate(licenses.wordings())]
    files += [(f"s{i}/x", f"the rights of kreel fishers, zorn by zorn, were kept\n\n1 {t}", k) for i, (k, t) in enumerate(licenses.wordings())]
    rows = licenses.scan(spark.createDataFrame(files, "path string, text string, want string")).collect()
    assert not [(r.path, r.want, r.own_licence, r.own_score) for r in rows if r.path[0] == "t" and r.own_score != 1.0]
    assert not [(r.path, r.want, r.own_licence, r.own_score) for r in rows if r.own_licence is None]
    assert licenses.scan(spark.createDataFrame([("a", "Distributed under the terms of the MIT"), ("b", "x\t GPL-3.0-only")], "path string, text string")).where("own_licence is null").isEmpty()


def test_no_passage_without_a_cue_reaches_the_threshold():
    for threshold in (licenses.THRESHOLD, 0.5):
        cue, rest = licenses.cues(threshold), {}
        for i, _, word, x in licenses.vectors()[1]:
            if not re.search(cue, word.upper()):
                rest[i] = rest.get(i, 0) + x * x
        assert all(math.sqrt(x) < threshold for x in rest.values())


def test_sql_on_odd_files(spark, tmp_path):
    """The scan and its SQL, on texts that the tables do not have."""
    texts = ["GNU GPL v3", "Mit.", "MIT", "mit und", "x\tDistributed  under the terms of the\tGPL-2.0-only\r\n\r\nplain", "CC BY 4.0", "", None, "\n\n\n", "É(c)MIT License" + " zorn" * 40, "LICENSE\n" * 50, "the rights to copyright, released: licensed under the Apache License, Version 2.0, the zorn " * 3]
    files = spark.createDataFrame([(i, f"d{i % 3}/f{i}", t) for i, t in enumerate(texts * 2)], "doc_id long, path string, text string")
    files.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    (part,) = (tmp_path / "documents.parquet").glob("*.parquet")
    assert_same(licenses.scan(files), licenses.oracle(f"SELECT * FROM read_parquet('{part}')"), SF)
