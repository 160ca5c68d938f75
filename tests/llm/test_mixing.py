from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        weights = sum(weight[s] for s in names if s not in full)
        share = {s: 3 * sizes[s] if s in full else left * weight[s] / weights for s in names}
        over = {s for s in names if s not in full and share[s] > 3 * sizes[s]}
        if not over:
            return share
        full |= over


def rows():
    out = []
    for i in range(900):
        out.append((i, "w " * (i % 37), f"s{min(i % 11, 6)}" if i % 50 else None, "x"))
    return out + [(2000, None, "s1", "x"), (2001, "", "zero", "x"), (None, "a b", "s2", "x"), (5, out[5][1], out[5][2], "x"), (2002, "one", "tiny", "x")]


def test_targets_and_takes(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.mix(frame).collect()
    source = {i: s for i, _, s, _ in rows()}
    sizes, taken, target = Counter(), Counter(), {}
    largest = defaultdict(int)
    assert len(got) == len(rows())
    for r in got:
        s = source[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r["size"])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    want = brute_targets({s: sizes[s] for s in source.values()})
    for s in target:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= largest[s]
    again = mixing.mix(frame.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_few_sources_and_none(spark, monkeypatch):
    frame = spark.createDataFrame(rows(), SCHEMA)
    want = Counter(map(tuple, mixing.mix(frame).collect()))
    monkeypatch.setattr(mixing, "FEW", 0)  # without a broadcast
    assert Counter(map(tuple, mixing.mix(frame).collect())) == want
    copies = {r.doc_id: r.copies for r in mixing.mix(frame).collect()}
    again = Counter(r.doc_id for r in mixing.resample(frame).collect())
    assert all(again[i] == n * (1 + (i == 5)) for i, n in copies.items())
    assert mixing.resample(frame).columns == frame.columns
    assert mixing.mix(frame.limit(0)).count() == 0
    blank = frame.withColumn("text", F.lit(" "))
    assert {(r.taken, r.target) for r in mixing.mix(blank).collect()} == {(0, 0.0)}


def test_a_repeated_id_and_long_texts_are_split_by_their_texts(spark):
    long = "word " * 60_000
    data = [(None, f"a b t{i}", "hot", "x") for i in range(400)] + [(7, f"{i} c", "cold", "x") for i in range(400)] + [(8, long, None, "x")]
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(taken) == 3 and all(abs(taken[s] - t) <= (3 if s < 60_000 else 60_000) for s, t in target.items())


def test_equal_rows_are_split_where_the_budget_ends(spark):
    rows = [(7, "one two three four five six seven eight nine ten", "a", "x")] * 900 + [(i, "w " * (1 + i % 9), "a", "x") for i in range(1000, 1100)]
    rows += [(i, "b " * 20, s, "x") for i in range(2000, 2400) for s in ("b",)] + [(None, "c c c", "c", "x")] * 500
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = mixing.mix(frame).collect()
    taken, target = Counter(), {}
    names = {s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in ("a", "b", "c")}
    by_size = {n: s for s, n in names.items()}
    for r in got:
        s = by_size[r.source_size]
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert len(got) == len(rows) and brute_targets(names) == pytest.approx(target)
    for s in names:
        assert abs(taken[s] - target[s]) <= 10, s
    again = mixing.mix(frame.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    kept = mixing.resample(frame)
    words = {r.source: r.n for r in kept.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    assert words == {s: n for s, n in taken.items() if n}
