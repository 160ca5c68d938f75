import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import ann, maxscore


def rows(n, width=8, seed=0, spread=1.0):
    r = random.Random(seed)
    out = [(i, [r.gauss(0, spread) for _ in range(width)], "x") for i in range(n)]
    out += [(n + i, out[3][1], "x") for i in range(30)]  # copies tie
    out += [(900, None, "x"), (901, [None] + [1.0] * (width - 1), "x"), (902, [math.nan] * width, "x")]
    out += [(903, [math.inf] * width, "x"), (None, [1.0] * width, "x"), (7, out[7][1], "x")]
    return out


SCHEMA = "vec_id long, embedding array<double>, score string"


def brute(data, queries, k, measure):
    table = {i: v for i, v, _ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q in queries & table.keys():
        scored = sorted((-measure(table[q], v), i) for i, v in table.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_maxscore_equals_brute_force(spark):
    scaled = lambda a, b: sum(math.floor(x * 1024) * math.floor(y * 1024) for x, y in zip(a, b))
    for spread in (0.2, 5000.0):
        data = rows(400, spread=spread)
        frame = spark.createDataFrame(data, SCHEMA)
        got = collected(maxscore.search(frame, F.col("vec_id") % 20 == 0, 10, shard_rows=100))
        assert got == brute(data, {i for i, *_ in data if i is not None and i % 20 == 0}, 10, scaled)
    assert maxscore.search(frame.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], ""), (1, [0.0], ""), (2, [], "")], SCHEMA)
    assert collected(maxscore.search(few, F.col("vec_id") == 0)) == {0: [(1, 0), (2, 0)]}


def test_maxscore_prunes_rows_before_the_last_terms():
    r = np.random.default_rng(0)
    weights = r.integers(-200, 200, (64, 3000)) * np.geomspace(1, 0.01, 64)[:, None]
    shard, q = maxscore.Shard(np.arange(3000), np.floor(weights).astype(np.int64)), r.integers(-200, 200, 64)
    found, scores = shard.search(q, 5, 10)
    exact = q @ np.floor(weights).astype(np.int64)
    exact[5] = -(1 << 60)
    assert found.tolist() == np.lexsort((np.arange(3000), -exact))[:10].tolist()
    assert scores.tolist() == exact[found].tolist()


def test_nearest_has_recall_and_exact_scores(spark):
    data = rows(800, width=16, seed=1) + [(950, [0.0] * 16, "x"), (951, [1.0] * 3, "x")]
    frame = spark.createDataFrame(data, SCHEMA)
    got = collected(ann.search(frame, F.col("vec_id") % 20 == 0, 20, list_rows=40, shard_rows=300))
    dot = lambda a, b: float((np.array(a) * np.array(b)).sum()) if len(a) == len(b) else -1e300
    want = brute([d for d in data if d[0] not in (950, 951)], {i for i, *_ in data if i is not None and i % 20 == 0}, 20, dot)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = {i: v for i, v, _ in data}
    for q, found in got.items():
        assert all(s == dot(exact[q], exact[i]) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
    few = spark.createDataFrame(data[:3], SCHEMA)
    assert sorted(len(x) for x in collected(ann.search(few, F.lit(True))).values()) == [2, 2, 2]
    assert ann.search(frame.limit(0), F.lit(True)).count() == 0


def test_nearest_finds_k_rows_for_outliers_and_repeated_ids(spark):
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = unit(r.normal(size=(12, 32)))
    tight = unit(np.repeat(groups, 8, axis=0) + 1e-3 * r.normal(size=(96, 32)))
    table = np.concatenate((tight, unit(r.normal(size=(10, 32)))))
    data = [(i, v.tolist(), "x") for i, v in enumerate(table)] + [(1, table[1].tolist(), "x")] * 200
    got = collected(ann.search(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 5 == 0, 20, list_rows=14))
    assert len(got) == 22 and all(len(x) == 20 for x in got.values())
    assert all(len({i for i, _ in x}) == 20 for x in got.values())


def test_nearest_prunes_lists_and_replicates_boundaries(spark, monkeypatch):
    r = np.random.default_rng(0)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    table = unit(np.repeat(unit(r.normal(size=(60, 32))), 50, axis=0) + 0.08 * r.normal(size=(3000, 32)))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<float>")
    table = table.astype(np.float32).astype(float)
    for flat in (ann.FLAT, 16):  # one level of lists, and lists fitted cell by cell
        monkeypatch.setattr(ann, "FLAT", flat)
        found, figures = ann.probed(frame, F.col("vec_id") % 20 == 0, 20, shard_rows=500, query_rows=20)
        got = collected(found)
        want = {q: np.lexsort((np.arange(3000), -np.where(np.arange(3000) == q, -9, table @ table[q])))[:20].tolist() for q in range(0, 3000, 20)}
        assert got.keys() == want.keys()
        assert np.mean([len({i for i, _ in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9
        assert figures["lists"] >= 60 and figures["share"] < 0.2 and figures["copies"] > 1.1


def test_nearest_has_recall_on_groups_with_outliers_and_on_uneven_norms(spark):
    r, n = np.random.default_rng(0), 10_000
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    loose = unit(r.normal(size=(n, 64)))
    tight = unit(r.normal(size=(20, 64))[r.integers(0, 20, n // 2)] + 0.01 * r.normal(size=(n // 2, 64)))
    for table in (np.concatenate((tight, loose[: n // 2])), loose * np.exp(r.normal(size=(n, 1)))):
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "vec_id long, embedding array<double>")
        got, hits = collected(ann.search(frame, F.col("vec_id") % 20 == 0, 20)), []
        for q in range(0, n, 20):
            scores = table @ table[q]
            scores[q] = -np.inf
            hits.append(np.mean([s >= np.partition(scores, n - 20)[n - 20] - 1e-12 for _, s in got[q]]))
        assert len(got) == n // 20 and np.mean(hits) >= 0.9


def test_lists_are_balanced():
    r = np.random.default_rng(1)
    x = np.concatenate((r.normal(size=(1800, 8)) * 0.2, r.normal(size=(200, 8)) + 4)).astype(np.float32)
    sizes = np.bincount(ann.squared(x, ann.balanced(x, 40)).argmin(1), minlength=40)
    assert sizes.max() <= 4 * sizes.mean()


def test_a_repeated_id_has_its_smallest_vector(spark):
    data = [(i, [float(i), 1.0], "x") for i in range(8)] + [(3, [-5.0, 1.0], "x"), (3, [9.0, 9.0], "x"), (0, [0.0, -2.0], "x")]
    frame = spark.createDataFrame(data, SCHEMA)
    kept = {i: [float(i), 1.0] for i in range(8)} | {3: [-5.0, 1.0], 0: [0.0, -2.0]}
    rows_ = [(i, v, "x") for i, v in kept.items()]
    assert collected(ann.search(frame, F.col("vec_id") < 4, 20)) == brute(rows_, {0, 1, 2, 3}, 20, lambda a, b: sum(x * y for x, y in zip(a, b)))
    scaled = lambda a, b: sum(math.floor(x * 1024) * math.floor(y * 1024) for x, y in zip(a, b))
    assert collected(maxscore.search(frame, F.col("vec_id") < 4)) == brute(rows_, {0, 1, 2, 3}, 10, scaled)


def test_nearest_takes_the_best_row_of_a_repeated_id():
    ids, vectors = np.array([7] * 400 + [8, 9]), np.concatenate((np.linspace(1, 2, 400), [0.5, 0.4]))[:, None]
    found, scores = ann.top(vectors[:, 0], ids, vectors, np.ones(1), 0, 3)
    assert found.tolist() == [7, 8, 9] and scores.tolist() == [2, 0.5, 0.4]
