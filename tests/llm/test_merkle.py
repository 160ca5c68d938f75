"""The Merkle manifest against a plain-Python tree, over heights, groups, ties and tampering."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, extra string, _pos string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(nodes):
    """(top, for each node its siblings level by level as (left, right))."""
    paths, at, owners = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(at) > 1:
        new, own = [], []
        for i in range(0, len(at), 8):
            run = at[i : i + 8]
            for j in range(len(run)):
                for o in owners[i + j]:
                    paths[o].append((run[:j], run[j + 1 :]))
            new.append(h(*run))
            own.append([o for x in owners[i : i + 8] for o in x])
        at, owners = new, own
    return at[0], paths


def brute(rows):
    """The query's rows by sorting everything."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, out = [], []
    for g in names:
        members = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in members])
        tops.append((top, members, paths))
    root, above = tree([t for t, _, _ in tops])
    for (top, members, paths), over in zip(tops, above, strict=True):
        for r, p in zip(members, paths, strict=True):
            steps = p + over
            other = r
            if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 3 == 0 and r[4] is not None:
                other = (*r[:4], r[4].translate(LOWER))
            at = leaf(other)
            for left, right in steps:
                at = h(*left, at, *right)
            out.append((r[0], leaf(r), top, root, h(*(x for s in steps for x in (*s[0], *s[1]))), at, at == root))
    return out


def found(spark, rows, name=None):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    got = merkle.verify(frame, {"text": F.when(merkle.tampered(), merkle.lowered(F.col("text"))).otherwise(F.col("text"))}, COLUMNS)
    return [tuple(r)[:7] for r in got.collect()]


def made(n, langs, seed=1):
    r = random.Random(seed)
    return [(i * 3, r.choice(["a", None, "é"]), r.choice(langs), r.choice([None, i]), r.choice([None, "", "ÀB c", f"text {i}", f"Text {i} ß"])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_heights_of_one_group(spark, n):
    rows = made(n, ["en"])
    assert sorted(found(spark, rows)) == sorted(brute(rows))


def test_several_supersteps_groups_and_odd_rows(spark, monkeypatch):
    rows = made(700, ["en", "fr", "é", "a", "B", None, "de", "z", "y", "x"])
    rows += [(None, "s", "en", 1, "Null Id"), (None, "s", "en", 1, "Null Id"), (None, None, None, None, None), (3, "s", "en", 1, "Tie"), (3, "t", "en", 1, "Tie"), (99999, "s", "en", 3, "Long Text " * 30000)]
    rows += [(77, "s", "en", 1, "Copy")] * 60
    rows += [(10**6 + i, "s", f"g{i:03d}", 1, "lone") for i in range(70)]
    key = lambda x: tuple(str(y) for y in x)
    want = sorted(brute(rows), key=key)
    assert sorted(found(spark, rows), key=key) == want
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "WIDTH", 8)
    monkeypatch.setattr(merkle, "FEW", 3)
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = merkle.numbered(frame, "lang", ["doc_id"]).groupBy("lang").agg(F.max("_pos"), F.min("_n"), F.count("*"), F.count_distinct("_pos")).collect()
    assert all(x[1] + 1 == x[2] == x[3] == x[4] for x in got) and len(got) == 80


def test_small_blocks_need_many_supersteps():
    """The same steps in one process with blocks of 8, so that groups halt in different supersteps."""
    for n in (1, 5, 8, 9, 63, 64, 65, 600):
        nodes = [h(str(i)).encode() for i in range(n)]
        top, paths = tree([x.decode() for x in nodes])
        found = merkle.levels(merkle.WIDTH if n <= merkle.WIDTH else n, nodes[: merkle.WIDTH])
        if n <= merkle.WIDTH:
            assert found[-1] == [top.encode()]
            for i, p in enumerate(paths):
                assert merkle.path(found, i) == [("".join(a).encode(), "".join(b).encode()) for a, b in p]
                assert merkle.folded(nodes[i], merkle.path(found, i)) == top.encode()
        else:
            assert len(found) == merkle.LEVELS + 1 and len(found[-1]) == 1


def test_many_leaves_in_several_supersteps(spark):
    rows = [(i, "s", "en" if i % 50 else "fr", i, f"Row {i}") for i in range(6000)]
    assert sorted(found(spark, rows)) == sorted(brute(rows))


def test_empty_table_and_the_query(spark):
    assert found(spark, []) == []
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*COLUMNS).collect()]
    got = queries.queries()["op13_merkle"](spark, sf)
    kinds = dict(got.dtypes)
    wanted = {"doc_id": "bigint", "verified": "boolean"} | {c: "string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")}
    assert {c: kinds[c] for c in wanted} == wanted
    got = got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    assert {r.verified for r in got} == {True, False}
