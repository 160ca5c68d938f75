"""Density clusters against a version in plain Python, by the definition."""

import math
import random

import numpy as np

from tidemark.operators import audit, density


def brute(points, least):
    """{id: cluster}: components at falling thresholds, the selection from the leaves on."""
    ids = sorted(points)
    v = np.array([points[i] for i in ids], np.float64)
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2)), density.PLACES)
    core = np.sort(d, axis=1)[:, least - 1]  # the point itself comes first
    w = np.maximum(np.maximum(d, core[:, None]), core[None])

    def components(members, below):
        left, out = set(members), []
        while left:
            todo = [left.pop()]
            got = set(todo)
            while todo:
                x = todo.pop()
                near = {y for y in left if w[x, y] < below}
                left -= near
                got |= near
                todo += near
            out.append(sorted(got))
        return out

    def grow(members, top):
        """(stability of the selection, the selected clusters) of the cluster that begins below ``top``."""
        total, now = 0.0, members
        while True:
            # the level at which it is held together: the heaviest edge of its spanning tree
            level = max(prim(now))
            large = [c for c in components(now, level) if len(c) >= least]
            kept = {x for c in large for x in c}
            if len(large) == 1:
                total += (len(now) - len(kept)) / max(level, density.NEAREST)
                now = large[0]
                continue
            total += len(now) / max(level, density.NEAREST) - (len(members) / max(top, density.NEAREST) if top < math.inf else 0)
            below = [grow(c, level) for c in large]
            inner = sum(s for s, _ in below)
            if top == math.inf or inner > total:
                return inner, [x for _, found in below for x in found]
            return total, [members]

    def prim(members):
        inside, best, out = {members[0]}, {x: w[members[0], x] for x in members[1:]}, []
        while best:
            x = min(best, key=lambda y: (best[y], y))
            out.append(best.pop(x))
            for y in best:
                best[y] = min(best[y], w[x, y])
        return out

    label = dict.fromkeys(ids, -1)
    if len(ids) >= least:
        for k, c in enumerate(sorted(grow(list(range(len(ids))), math.inf)[1])):
            label |= {ids[x]: k for x in c}
    return label


def groups(seed, n, size=8, noise=40, copies=0):
    r = np.random.default_rng(seed)
    rows = [r.normal(size=size) * 3 + r.normal(size=size) * 0.0 for _ in range(noise)]
    for _ in range(6):
        centre, width = r.normal(size=size) * 4, r.uniform(0.1, 0.8)
        rows += [centre + r.normal(size=size) * width for _ in range((n - noise - copies) // 6)]
    rows += [rows[-1]] * (n - len(rows))
    order = random.Random(seed).sample(range(n), n)
    return {order[i] + 10: [float(x) for x in row] for i, row in enumerate(rows)}


def found(spark, points, least, **k):
    rows = spark.createDataFrame(list(points.items()), "id long, v array<double>")
    return {r.id: r.cluster for r in density.density_clusters(rows, "id", "v", least, **k).collect()}


def test_equals_the_definition_and_feeds_the_audit(spark, monkeypatch):
    monkeypatch.setattr(density, "PART", 60)
    monkeypatch.setattr(density, "CHUNK", 50)
    points = groups(3, 300, copies=9)
    got, want = found(spark, points, 6), brute(points, 6)
    assert max(want.values()) >= 2 and -1 in want.values()
    assert got == want
    rows = spark.createDataFrame([(c, "debug" if i % 2 else "test") for i, c in got.items()], "cluster long, category string")
    table = audit.crosstab(rows, "cluster", "category")
    assert sum(r.n for r in table.collect()) == sum(c != -1 for c in got.values())
    assert audit.merges(table).count() > 0


def test_ties_and_far_groups(spark, monkeypatch):
    monkeypatch.setattr(density, "PART", 50)
    points = {i: [float(i % 9) + (500 if i > 80 else 0), float(i // 9 % 9)] for i in range(162)} | {900 + i: [6000.0, float(i)] for i in range(9)}
    assert found(spark, points, 5) == brute(points, 5)


def test_few_odd_and_repeated_rows(spark):
    schema = "id long, v array<double>"
    assert density.density_clusters(spark.createDataFrame([], schema), "id", "v").collect() == []
    few = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (2, [1.0]), (None, [1.0]), (3, None), (4, [None]), (5, [math.inf]), (6, [1.0, 2.0]), (7, [])], schema)
    assert {r.id: r.cluster for r in density.density_clusters(few, "id", "v").collect()} == dict.fromkeys(range(1, 8), -1)
    assert set(found(spark, {i: [1.0, 2.0] for i in range(12)}, 9).values()) == {-1}  # one cluster is none


def counted(monkeypatch):
    """The numbers of rows with a vector in the tables that are written from now on."""
    written = []

    class Counted(density.Written):
        def __call__(self, df):
            out = super().__call__(df)
            if "vector" in df.columns:
                written.append(out.count())
            return out

    monkeypatch.setattr(density, "Written", Counted)
    return written


def test_vectors_are_written_a_few_times_however_many_cells_they_look_into(spark, monkeypatch):
    monkeypatch.setattr(density, "PART", 8)
    monkeypatch.setattr(density, "CHUNK", 8)
    written = counted(monkeypatch)
    r = np.random.default_rng(5)
    points = {i: [float(x) for x in r.normal(size=8)] for i in range(160)}  # without structure: no cell is ruled out
    assert found(spark, points, 4) == brute(points, 4)
    assert sum(written) <= 4 * len(points)


def test_copies_are_searched_for_once(spark, monkeypatch):
    monkeypatch.setattr(density, "PART", 10)
    written = counted(monkeypatch)
    r = np.random.default_rng(9)
    base = [[float(x) for x in r.normal(size=4)] for _ in range(40)]
    points = dict(enumerate(v for k, v in enumerate(base) for _ in range((1, 2, 3, 7)[k % 4])))
    assert found(spark, points, 5) == brute(points, 5)
    assert sum(written) == len(points) + 2 * len(base)  # as given, then each of them once, without and with its cell
