import math
import re
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import license_scan as ls

FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/x.py", "plain text\nwithout any notice"),
    (3, "a/b/c/y.py", None),
    (4, "a/b/c/z.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 200),
    (5, "d/e/f.txt", "nothing"),
    (6, "d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3.\n\n" + "and more " * 100),
    (7, "top.txt", "a license is mentioned among very many other words of ordinary prose here"),
    (8, None, "no path"),
    (9, "a//b/w.py", ""),
    (2, "a/b/x.py", "plain text\nwithout any notice"),
    (None, "g/h.txt", "LICENSED UNDER THE APACHE LICENSE,### VERSION 2.0."),
    (10, "g/i.txt", "x"),
]


TELLING = ls.Templates(ls.TEMPLATES, ls.COSINE).telling


def brute_cosines(text):
    bags = [(n, Counter(re.findall(ls.WORDS, t.lower()))) for n, t in ls.TEMPLATES]
    spread = Counter(w for _, b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (spread[w] or 1)) * (0.5 if w in ls.COMMON and spread[w] else 1)
    lines = [x for line in (text or "").split("\n") if (x := re.findall(ls.WORDS, line.lower()))]
    found = {}
    for start, line in enumerate(lines):
        for size in ls.WINDOWS if TELLING & set(line) else ():
            bag = {w: (1 + math.log(n)) * idf(w) for w, n in Counter(w for x in lines[start : start + size] for w in x).items()}
            norm = math.sqrt(sum(x * x for x in bag.values()))
            for name, other in bags:
                o = {w: (1 + math.log(n)) * idf(w) for w, n in other.items()}
                cosine = round(sum(bag.get(w, 0) * x for w, x in o.items()) / norm / math.sqrt(sum(x * x for x in o.values())), 6)
                if cosine >= ls.COSINE:
                    found[name] = max(cosine, found.get(name, 0))
    return min(((n, c) for n, c in found.items()), key=lambda x: (-x[1], x[0]), default=None)


def test_no_passage_without_a_telling_word_reaches_the_least_cosine():
    to = ls.Templates(ls.TEMPLATES, ls.COSINE)
    assert not to.telling & ls.COMMON
    for row in to.units:
        rest = [x for w, x in zip(to.place, row, strict=False) if w not in to.telling]
        assert math.sqrt(sum(x * x for x in rest)) < ls.COSINE


def wrapped(text, width, mark):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


@pytest.mark.parametrize(("width", "mark"), [(40, ""), (60, "# "), (72, " * "), (76, "// ")])
def test_wrapped_notices_are_told_apart(width, mark):
    to = ls.Templates(ls.TEMPLATES, ls.COSINE)
    longest = {}
    for name, text in ls.TEMPLATES:
        longest[name] = max(longest.get(name, ""), text, key=len)
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "EPL-2.0"} <= longest.keys()
    for name, text in longest.items():
        notice = wrapped("Copyright (c) 2019 A. Person and others", width, mark) + "\n" + mark + "\n" + wrapped(text, width, mark)
        assert to.best("#!/bin/sh\n" + notice + "\n\nimport os\n" + "x = compute(y)\n" * 50)[0] == name
    for name, text in ls.TEMPLATES:
        if len(text.split()) > 12:
            assert to.best(wrapped(text, width, mark))[0] == name, text


def test_whole_licence_files_are_known():
    to = ls.Templates(ls.TEMPLATES, ls.COSINE)
    filler = "\n".join("Section text of a long document that goes on about terms" for _ in range(300))
    for title, name in (
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "GPL-3.0"),
        ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n", "GPL-2.0"),
        ("                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n", "LGPL-2.1"),
        ("                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n", "LGPL-3.0"),
        ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n", "AGPL-3.0"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", "Apache-2.0"),
        ("Mozilla Public License Version 2.0\n==================================\n", "MPL-2.0"),
        ("Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE (AGREEMENT).\n", "EPL-2.0"),
    ):
        assert to.best(title + "\n" + filler)[0] == name


def test_long_lines_and_ordinary_prose():
    to = ls.Templates(ls.TEMPLATES, ls.COSINE)
    assert to.best("word " * 300_000 + "license") == (None, None)
    assert to.best("the software that we use may not copy files without permission of the owner\n" * 2000) == (None, None)
    assert to.best("") == (None, None)


def test_scan_equals_brute_force_and_inherits(spark):
    frame = spark.createDataFrame(FILES, "file_id long, where string, content string")
    got = ls.scan(frame, "file_id", "where", "content").collect()
    assert len(got) == len(FILES)
    by = {r.file_id: r for r in got}
    for i, _, text in FILES:
        own = brute_cosines(text)
        r = by[i]
        assert (r.origin == "own") == (own is not None)
        if own:
            assert r.licence == own[0] and abs(r.cosine - own[1]) < 1e-6
    found = {i: (r.origin, r.licence, r.inherited_from) for i, r in by.items()}
    assert found[1][1] == "MIT" and found[4][1] == "Apache-2.0" and found[None][1] == "Apache-2.0"
    assert found[2] == found[9] == ("inherited", "MIT", "a") and found[3] == ("inherited", "MIT", "a")
    assert found[5] == ("inherited", "GPL-3.0", "d") and found[10] == ("inherited", "Apache-2.0", "g")
    assert found[7] == found[8] == ("none", None, None)
    assert ls.scan(frame.limit(0), "file_id", "where", "content").count() == 0


def test_ties_null_ids_and_repeated_rows(spark):
    rows = [(None, "p/a.txt", "Released under the MIT License."), (None, "p/b.txt", "Licensed under CC BY 4.0."), (1, "p/c.txt", None), (1, "p/c.txt", None)]
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "doc_id", "path", "text").collect()
    assert sorted((str(r.doc_id), r.path, r.licence) for r in got) == [("1", "p/c.txt", "CC-BY-4.0"), ("1", "p/c.txt", "CC-BY-4.0"), ("None", "p/a.txt", "MIT"), ("None", "p/b.txt", "CC-BY-4.0")]
    two = [("A", "alpha beta gamma"), ("B", "alpha beta gamma")]
    assert ls.Templates(two, 0.6).best("alpha beta gamma")[0] == "A"
    assert ls.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("licence", F.lit("x")), "doc_id", "path", "text").count() == 4
