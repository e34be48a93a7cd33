import math
import re

from pyspark.sql import functions as F

from cachescope.llm import licenses

from .helpers import EDGES, empty, frame, words

MIT, APACHE = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
FILES = [
    ("LICENSE", MIT[1]), ("a.py", "\n".join(["code"] * 3 + words(1, 50))),
    ("lib/LICENSE", APACHE[1]), ("lib/x/y/z.py", " ".join(words(2, 80))), ("lib/x/own.py", "first line\n" + MIT[0] + "\nmore " + " ".join(words(3, 60))),
    ("library/q.py", " ".join(words(4, 80))), ("other/gpl.txt", "head " + " ".join(words(5, 90)) + "\n" + licenses.TEMPLATES["GPL-3.0"][0]),
    ("other/none.txt", None), ("deep/a/b/c/d.txt", ""), (None, "nothing at all"), (None, MIT[0]),
]


def files(spark):
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(FILES)], "id long, path string, text string")


def brute(rows, least=licenses.MIN_COSINE):
    """Own licence (name, line or None) of each file, scoring every line with every template."""
    known = licenses.template_terms(licenses.TEMPLATES)
    vocab = {w for _, ws in known for w in ws}
    terms = lambda t: {w for w in re.split("[^a-z0-9]+", t.lower()) if w}
    n = len(rows)
    df = {w: sum(w in terms(t or "") for _, t in rows) for w in vocab}
    idf = lambda w: math.log((n + 1) / (df[w] + 1)) + 1e-6 if w in vocab else max(math.log(n + 1), 1.0)

    def best(unit):
        norm = math.sqrt(sum(idf(w)**2 for w in unit))
        found = [(-sum(idf(w)**2 for w in unit & set(ws)) / (norm * math.sqrt(sum(idf(w)**2 for w in ws))), name)
                 for name, ws in known] if norm else [(0.0, "")]
        return min(found)

    out = []
    for _, t in rows:
        whole = best(terms(t or ""))
        lines = [(*best(terms(x)), k + 1) for k, x in enumerate((t or "").split("\n"))]
        line = min((c, k, name) for c, name, k in lines)
        out.append((whole[1], None) if -whole[0] >= least else (line[2], line[1]) if -line[0] >= least else (None, None))
    return out


def test_own_statements_equal_brute_force(spark):
    got = licenses.own_licenses(files(spark), "path", "text").orderBy("id").collect()
    assert [(r.license, r.line_no) for r in got] == brute(FILES)


def test_inheritance_from_the_nearest_directory(spark):
    got = {(r.path or r.id): r for r in licenses.scan(files(spark).withColumn("license", F.lit("mine"))).collect()}
    pick = lambda p: (got[p].license, got[p].scope, got[p].inherited_from)
    assert pick("LICENSE") == ("MIT", "file", None)
    assert pick("a.py") == ("MIT", "inherited", "")
    assert pick("lib/x/y/z.py") == ("Apache-2.0", "inherited", "lib")
    assert pick("lib/x/own.py") == ("MIT", "header", None)
    assert pick("library/q.py") == ("MIT", "inherited", "")
    assert pick("other/gpl.txt")[:2] == ("GPL-3.0", "header")
    assert pick("other/none.txt") == ("MIT", "inherited", "")
    assert pick("deep/a/b/c/d.txt") == ("MIT", "inherited", "")
    assert pick(9) == (None, None, None) and pick(10)[0] == "MIT"


GPL_HEADER = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MIT_FILE = """MIT License

Copyright (c) 2020 Some Body

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
SOFTWARE."""


def test_wrapped_headers_and_full_texts(spark):
    code = "\n".join(" ".join(words(k, 8)) for k in range(40))
    narrow = "\n".join("// " + w for w in licenses.TEMPLATES["GPL-3.0"][1].split())
    rows = [("a/gpl.py", "#!/bin/x\n#\n" + GPL_HEADER + "\n" + code), ("a/narrow.c", code + "\n" + narrow + "\n" + code),
            ("a/none.py", code), ("b/LICENSE", MIT_FILE), ("b/notes.txt", "All rights reserved."), ("b/src/x.py", code),
            ("c/license.py", GPL_HEADER + "\n" + code), ("c/x.py", code)]
    got = {r.path: r for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    pick = lambda p: (got[p].license, got[p].scope, got[p].line_no, got[p].inherited_from)
    assert pick("a/gpl.py") == ("GPL-3.0", "header", 3, None) and got["a/gpl.py"].cosine > 0.99
    assert pick("a/narrow.c") == ("GPL-3.0", "header", 41, None) and got["a/narrow.c"].cosine > 0.99
    assert pick("a/none.py") == (None, None, None, None)
    assert pick("b/LICENSE")[:2] == ("MIT", "file")
    assert pick("b/src/x.py") == ("MIT", "inherited", None, "b")
    assert pick("c/license.py")[:2] == ("GPL-3.0", "header") and pick("c/x.py")[0] is None


def test_edges(spark):
    docs = frame(spark, EDGES).withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    got = licenses.scan(docs).collect()
    assert len(got) == len(EDGES) and not any(r.license for r in got)
    assert licenses.scan(empty(spark).withColumn("path", F.lit("x"))).collect() == []


def test_no_python_on_the_main_path(spark):
    plan = licenses.scan(files(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
