"""Spelling variants against comparing all pairs, wavelet trees against plain ranges."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries, spelling
from tidemark.llm.common import table


def near(a, b):
    """One inserted, deleted or replaced letter makes the words equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    """{word: (form, root, n, n_near, form_n)} by comparing all pairs."""
    out, form = {}, {}
    for w, n in counts.items():
        some = [u for u in counts if near(w, u)]
        best = min(some, key=lambda u: (-counts[u], u), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
        out[w] = [form[w], None, n, len(some), counts[best] if form[w] else None]
    for w in counts:
        at = w
        while form[at] is not None:
            at = form[at]
        out[w][1] = at
    return {w: tuple(x) for w, x in out.items()}


def brute_counts(rows):
    """The words of (doc_id, text) rows."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def result(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_wavelet_tree_reports_rectangles():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 100, 257):
        values = r.permutation(n)
        lo, least = r.integers(0, n, 40), r.integers(0, n, 40)
        hi, most = np.minimum(n, lo + r.integers(0, n + 1, 40)), np.minimum(n, least + r.integers(0, n + 1, 40))
        query, value = spelling.WaveletTree(values).report(lo, hi, least, most)
        got = sorted(zip(query.tolist(), value.tolist(), strict=True))
        assert got == sorted((q, int(v)) for q in range(40) for v in values[lo[q] : hi[q]] if least[q] <= v < most[q])
    assert [x.tolist() for x in spelling.WaveletTree(np.array([], np.int64)).report(np.array([0]), np.array([0]), np.array([0]), np.array([0]))] == [[], []]


def some_words(n, seed, letters="abé"):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(7, 9))) for _ in range(n)})


def test_pairs_of_all_windows_are_all_pairs():
    words = [w.encode("latin-1") for w in some_words(400, 1)]
    for length in (7, 8, 9):
        here = [w for w in words if len(w) in (length, length + 1)]
        for edges in ([0, length + 1], [0, 4, length + 1], list(range(length + 2))):
            found = Counter()
            for first, last in zip(edges, edges[1:], strict=False):
                a, b = spelling.near_words(here, length, first, last)
                found.update(zip(a.tolist(), b.tolist(), strict=True))
            want = {(i, j) for i, a in enumerate(here) for j, b in enumerate(here) if len(a) == length and near(a.decode("latin-1"), b.decode("latin-1"))}
            assert set(found) == want and set(found.values()) <= {1}


@pytest.mark.parametrize(("crowd", "shard"), [(None, None), (60, 200), (1, 1)])
def test_variants_equal_brute_force(spark, monkeypatch, crowd, shard):
    if crowd:
        monkeypatch.setattr(spelling, "CROWD", crowd)
        monkeypatch.setattr(spelling, "SHARD", shard)
        monkeypatch.setattr(spelling, "QUERIES", 50)
    r = random.Random(2)
    words = some_words(250, 2) + ["x" * 7, "x" * 8, "x" * 9, "x" * 10, "y" * 7, "prefixsame" + "a" * 20, "prefixsame" + "a" * 19 + "b", "lonelyword"]
    counts = {w: r.choice([2, 2, 3, 20, 25, 200, 2000, 2000]) for w in words}
    got = result(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == brute(counts)
    assert any(x[1] != x[0] for x in got.values() if x[0])  # a chain of forms


def test_crowded_keys_are_split_and_lose_nothing(spark):
    words = spark.createDataFrame([(w, 2) for w in some_words(300, 4)], "word string, n long")
    rows = spelling.windows(words, crowd=25)
    assert rows.where("last - first = 1").count() > 0
    most = rows.groupBy("length", "first", "last", "key").count().where("last - first > 1").selectExpr("max(count * length)").first()[0]
    assert most is None or most <= 25


SCHEMA = "doc_id long, text string, word string, n string"


def test_words_of_texts_and_odd_rows(spark):
    long_text = "Encyclopædia " * 40_000 + "z" * 20_000
    rows = [(None, "Variante variante VARIANTE"), (1, None), (2, ""), (3, "12 ÉcoleÉcole ÉcoleÉcole œuvresdart"), (4, long_text), (5, "z" * 20_000), (6, "z" * 19_999 + "y " + "z" * 19_999 + "y")]
    rows += [(i, f"repeated repeatd variants{'x' * (i % 3)} ÷×abcdefgh") for i in range(100)] + [(7, "copied row copied")] * 3
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = {r.word: r.n for r in spelling.count_words(docs).collect()}
    assert got == brute_counts(rows)
    assert result(spelling.variants(spelling.count_words(docs))) == brute(brute_counts(rows))
    assert spelling.variants(spelling.count_words(docs.limit(0))).count() == 0


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    df = queries.queries()["op11_spelling"](spark, sf)
    kinds = dict(df.dtypes)
    wanted = {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert {c: kinds[c] for c in wanted} == wanted
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    counts = brute_counts(rows)
    got = result(df)
    assert {w: x[2] for w, x in got.items()} == counts
    some = dict(sorted(counts.items(), key=lambda x: (zlib.crc32(x[0].encode()), x[0]))[:300])
    for w in some:
        near_ones = [u for u in counts if abs(len(u) - len(w)) < 2 and near(w, u)]
        best = min(near_ones, key=lambda u: (-counts[u], u), default=None)
        assert got[w][3] == len(near_ones)
        assert got[w][0] == (best if best is not None and counts[best] >= 10 * counts[w] else None)
