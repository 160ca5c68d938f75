"""The keyed cache: touched, removed and replayed files, failing runs, orphans, and vectors made only where something changed."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.vectors import hashing_embedder
from tidemark.sources import store
from tidemark.sources.cache import KeyedCache, vectors


def keys(spark, rows):
    return spark.createDataFrame(rows, "key string, stamp string")


def test_only_what_changed_is_made(spark, tmp_path):
    cache, made = KeyedCache(spark, str(tmp_path / "c"), "n int"), []

    def make(missing):
        made.append(sorted(tuple(r) for r in missing.collect()))
        return missing.where("key <> 'empty'").select("key", "stamp", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("n"))

    got = lambda rows: sorted((r.key, r.stamp, r.n) for r in cache.refresh(keys(spark, rows), make).collect())
    two = lambda *pairs: sorted((k, s, n) for k, s in pairs for n in (1, 2))
    assert got([("a", "1"), ("b", "1"), ("empty", "1"), (None, "1")]) == two(("a", "1"), ("b", "1"))
    assert made == [[("a", "1"), ("b", "1"), ("empty", "1")]]
    assert got([("a", "1"), ("b", "1"), ("empty", "1")]) == two(("a", "1"), ("b", "1")) and len(made) == 1 and cache.version() == 1
    assert got([("a", "2"), ("b", "1"), ("c", "1"), ("empty", "1")]) == two(("a", "2"), ("b", "1"), ("c", "1")) and made[1] == [("a", "2"), ("c", "1")]
    with pytest.raises(Exception):  # noqa: B017
        cache.refresh(keys(spark, [("z", "1")]), lambda m: m.select("key", "stamp", F.raise_error(F.lit("lost")).cast("int").alias("n")))
    assert sorted((r.key, r.stamp, r.n) for r in cache.rows().collect()) == two(("a", "2"), ("b", "1"), ("c", "1"))
    assert got([("c", "1")]) == two(("c", "1")) and len(made) == 2
    assert spark.read.parquet(str(tmp_path / "c" / "batches")).count() == 2 and len(list((tmp_path / "c" / "manifests").iterdir())) == 1
    assert got([]) == [] and got([("a", "1")]) == two(("a", "1")) and len(made) == 3


def test_lines_of_touched_removed_and_replayed_files(spark, tmp_path):
    folder, bronze = tmp_path / "logs", str(tmp_path / "bronze")
    folder.mkdir()
    write = lambda name, *lines: (folder / name).write_text("\n".join(lines) + "\n")
    write("a.jsonl", "1", "2")
    write("b.jsonl", "3")
    current = lambda: sorted((r.file.rsplit("/", 1)[1], r.line, r.text) for r in store.land_new(spark, str(folder), bronze).collect())
    assert current() == [("a.jsonl", 1, "1"), ("a.jsonl", 2, "2"), ("b.jsonl", 1, "3")]
    version = KeyedCache(spark, bronze, "line int, text string").version()
    assert len(current()) == 3 and KeyedCache(spark, bronze, "line int, text string").version() == version
    os.utime(folder / "a.jsonl", (4e9, 4e9))  # touched
    assert len(current()) == 3
    write("a.jsonl", "1", "2", "4")  # grown, its lines replayed
    assert current() == [("a.jsonl", 1, "1"), ("a.jsonl", 2, "2"), ("a.jsonl", 3, "4"), ("b.jsonl", 1, "3")]
    (folder / "a.jsonl").unlink()
    assert current() == [("b.jsonl", 1, "3")]
    assert spark.read.parquet(f"{bronze}/batches").count() == 1  # orphans are gone


def test_vectors_follow_text_and_embedder(spark, tmp_path):
    cache = KeyedCache(spark, str(tmp_path / "v"), "vector array<float>")
    embed = hashing_embedder(8)
    texts = lambda *rows: spark.createDataFrame(list(rows), "key string, text string")
    batch = lambda: {r.key: r.batch for r in cache.manifest().collect()}
    first = {r.key: r.vector for r in vectors(cache, texts(("a", "one two"), ("b", "three"), ("c", None)), embed, "hash-8").collect()}
    assert first.keys() == {"a", "b", "c"}
    was = batch()
    second = {r.key: r.vector for r in vectors(cache, texts(("a", "one two"), ("b", "four"), ("c", None)), embed, "hash-8").collect()}
    assert second["a"] == first["a"] and second["b"] != first["b"] and batch()["a"] == was["a"] and batch()["b"] != was["b"]
    vectors(cache, texts(("a", "one two"), ("b", "four"), ("c", None)), hashing_embedder(4), "hash-4").collect()
    assert not set(batch().values()) & set(was.values()) and {len(r.vector) for r in cache.rows().collect()} == {4}
