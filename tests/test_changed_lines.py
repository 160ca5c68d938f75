"""Changed lines by expressions and block matching against the block matching alone."""

import difflib
import random

from pyspark.sql import functions as F

from tidemark.sources import logs


def want(a, b):
    codes = difflib.SequenceMatcher(None, (a or "").splitlines(), (b or "").splitlines(), autojunk=False).get_opcodes()
    return sum(c[4] - c[3] for c in codes if c[0] != "equal"), sum(c[2] - c[1] for c in codes if c[0] != "equal")


def found(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return {r.i: (r.c.added, r.c.deleted) for r in logs.with_changed_lines(rows, F.col("a"), F.col("b"), "c").collect()}


def test_counts_equal_the_matching(spark):
    r = random.Random(9)
    pairs = [("", ""), (None, "a"), ("a", None), ("a\n", "a"), ("a\r\nb\x0bc d", "a\nb\nc\nd"), ("a\n\n", "a"), ("\n", ""), ("a\nb\nc\na\nb\nc\nd", "a\nb\nc\nd\na\nb\nc\nd"), ("x\ny", "z"), ("a\nb\nc", "a\nq\nc")]
    for _ in range(300):
        lines = [r.choice("abcdef") for _ in range(r.randint(0, 8))] if r.random() < 0.6 else r.sample("abcdefghijkl", r.randint(0, 10))
        other = [x for x in lines if r.random() < 0.8]
        for _ in range(r.randint(0, 3)):
            other.insert(r.randint(0, len(other)), r.choice("abxyz"))
        r.random() < 0.1 and r.shuffle(other)
        pairs.append(("\n".join(lines), "\n".join(other) + r.choice(["", "\n"])))
    assert found(spark, pairs) == {i: want(a, b) for i, (a, b) in enumerate(pairs)}


def test_files_of_20000_lines(spark):
    r = random.Random(10)
    lines = [f"line {i} of a file" for i in range(20_000)]
    edited = [x for x in lines if r.random() > 0.001]
    for _ in range(20):
        edited.insert(r.randint(0, len(edited)), f"new {r.random()}")
    inside = lines[:9000] + ["one", "two"] + lines[9500:]
    pairs = [("\n".join(lines), "\n".join(edited)), ("\n".join(lines), "\n".join(inside)), ("\n".join(lines), "\n".join(lines))]
    assert found(spark, pairs) == {0: want(*pairs[0]), 1: (2, 500), 2: (0, 0)}
