import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, text, vectors
from tidemark.functions.intent_patterns import INTENTS

PATHS = {
    "/w/app/src/a.py": ("Python", "code", "src/a.py"), "/w/app/tests/x.rs": ("Rust", "test", "tests/x.rs"), "/w/app/Dockerfile": ("Dockerfile", "code", "Dockerfile"),
    "/w/application/b.ts": ("TypeScript", "code", "b.ts"), "C:\\w\\test_a.go": ("Go", "test", "test_a.go"), "x/y_test.c": ("C", "test", "y_test.c"),
    "/w/app/odd.zzz": ("zzz", "code", "odd.zzz"), "/w/app/none": ("other", "code", "none"), "/w/app/ab.spec.ts": ("TypeScript", "test", "ab.spec.ts"),
    "FooTests.java": ("Java", "test", "FooTests.java"), "/w/app/contest.py": ("Python", "code", "contest.py"),
}


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p in PATHS], "p string")
    found = rows.select("p", paths.language_of(F.col("p")), paths.kind_of(F.col("p")), paths.relative(F.col("p"), F.lit("/w/app/"))).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == PATHS


TEXTS = [
    None, "", "ok", "Merci, continue !", "why is this failing?", "what is it?", "fix the bug in the parser please, it crashes with a traceback",
    "add a unit test for the loader", "write the README documentation", "refactor this function to be simpler", "please review this pull request",
    "deploy to production and run the pipeline", "let's plan the next milestone", "implement the export feature", "corrige le bug stp", "Ajoute des tests unitaires",
    "<task-notification>done</task-notification>", "<system-reminder>x</system-reminder> yes", "bonjour", "the quick brown fox", "explain how the cache works", "that's great, well done, I love it",
]


def brute_intent(raw):
    flags = re.I
    clean = re.sub(r"(?is)<(system-reminder|task-notification)\b[^>]*>.*?</\1>", " ", raw or "")
    if re.search(r"(?i)<task-notification\b", raw or "") and not clean.strip():
        return "notification"
    if len(clean.strip()) <= text.ACK_CHARS and re.search(text.ACK.replace("(?iU)", "(?i)"), clean.strip()):
        return "followup"
    scores = dict.fromkeys(text.INTENT_ORDER, 0.0)
    for name, weight, patterns in INTENTS:
        scores[name] += sum(weight for p in patterns if re.search(p, clean, flags))
    best = max(scores.values())
    if best > 0:
        return next(n for n in text.INTENT_ORDER if scores[n] == best)
    return "question" if clean.strip().endswith("?") else "other"


def test_intents_equal_the_same_rules_in_python(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    found = {r.i: (r.intent, r.e) for r in rows.select("i", text.intent(F.col("t")).alias("intent"), text.lexical_evidence(F.coalesce("t", F.lit("")), "ops").alias("e")).collect()}
    assert [found[i][0] for i in range(len(TEXTS))] == [brute_intent(t) for t in TEXTS]
    assert len({x for x, _ in found.values()}) >= 8
    ops = next(p for n, _, p in INTENTS if n == "ops")
    for i, t in enumerate(TEXTS):
        assert found[i][1] == pytest.approx(1 - 0.4 ** sum(bool(re.search(p, t or "", re.I)) for p in ops))


def test_an_intent_names_each_pattern_once(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(text.intent(F.col("t")).alias("i"))._jdf.queryExecution().analyzed().expressions().head().sql()
    assert 0 < plan.count("RLIKE") <= sum(len(p) for _, _, p in INTENTS) + 2


def test_small_text_functions(spark):
    assert one(spark, "a\r\nb", text.preview) == "a  b" and one(spark, "=1", text.escape_formula) == "'=1" and one(spark, None, text.preview) == ""
    assert [one(spark, n, text.abbreviated, "long") for n in (12, 1234, 5_600_000, 1_010_000_000)] == ["12", "1.2k", "5.6M", "1.01G"]
    assert one(spark, "don't stop", text.count_tokens) == 4
    assert tuple(one(spark, " Debug | 4 ", text.parse_reply)) == ("debug", "4")
    assert tuple(one(spark, "poetry|9", text.parse_reply)) == ("other", "3") and tuple(one(spark, None, text.parse_reply)) == ("other", "3")
    label = lambda x: one(spark, x, lambda c: text.model_label(c, "acme-", ("small", "large")))
    assert [label(x) for x in ("acme-small-4-5-20251001", "acme-large-3", "other_kind-x", "", None)] == ["Small 4.5", "Large 3", "Other Kind X", "(unknown)", "(unknown)"]
    rows = spark.createDataFrame([("zeta",), ("acme-large-1",), ("acme-small-2",)], "m string").orderBy(text.model_rank(F.col("m"), ("small", "large")))
    assert [r.m for r in rows.collect()] == ["acme-small-2", "acme-large-1", "zeta"]
    assert [one(spark, 1234.5, lambda c, k=k: text.shown(c, k), "double") for k in ("money", "money_total", "pct", "ratio", "int")] == ["$1,234.5000", "$1,234.50", "1234.5%", "1,234.5", "1,234"]
    change = lambda a, b, k: spark.createDataFrame([(a, b)], "a double, b double").select(text.shown_change(F.col("a"), F.col("b"), k).alias("y")).first().y
    assert [change(10.0, 12.5, "pct"), change(10.0, 8.0, "money_total"), change(0.0, 3.0, "int"), change(None, 1.0, "ratio")] == ["+2.5 pp", "-$2.00 (-20%)", "+3", "-"]


def test_vectors(spark):
    rows = spark.createDataFrame([("a b c",), ("a b d",), ("x y z",), ("",), (None,)], "t string")
    found = [np.array(r.v) for r in rows.select(vectors.hashing_embedder(64)(F.col("t")).alias("v")).collect()]
    assert all(abs(np.linalg.norm(v) - 1) < 1e-5 for v in found[:3]) and not found[3].any() and not found[4].any()
    assert found[0] @ found[1] > found[0] @ found[2] + 0.2
    assert [round(x, 4) for x in one(spark, [3.0, 4.0], vectors.unit, "array<double>")] == [0.6, 0.8] and one(spark, [0.0], vectors.unit, "array<double>") == [0.0]
    assert one(spark, None, lambda c: vectors.missing(F.lit("a"), c)) is True
    assert one(spark, "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", lambda c: vectors.missing(F.lit("a"), c)) is False
