"""The rule ensemble: measures, rules against plain Python, held-out accuracy and odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality, queries
from tidemark.llm.common import fold, table

SF = "/root/testdata/sf0.01"


def test_measures_of_a_text():
    got = dict(zip(quality.MEASURES, quality.measures("Ab cd. É!\n\nab | 12\nab | 12".encode()), strict=True))
    assert got["log_words"] == math.log1p(9) and got["distinct_words"] == 6 / 9 and got["distinct_lines"] == 2 / 3
    assert got["upper"] == 1 / 8 and got["digits"] == 4 / 26 and got["marks"] == 2 / 26 and got["loud"] == 1 / 26
    assert got["pauses"] == 1 / 9 and got["common_pairs"] == 1 - 6 / 8 and got["log_line_words"] == math.log1p(3)
    assert quality.measures(b"") == quality.measures(b" \n ") == (0.0,) * len(quality.MEASURES)
    assert len(quality.measures(b"x")) == len(quality.MEASURES)


TREE = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=3
  If (feature 1 <= 0.5)
   Predict: 0.0
  Else (feature 1 > 0.5)
   If (feature 1 <= 2.0E-1)
    Predict: 0.0
   Else (feature 1 > 2.0E-1)
    If (feature 0 <= 7.0)
     Predict: 1.0
    Else (feature 0 > 7.0)
     Predict: 0.0
"""


def test_paths_become_conjunctions():
    inf = math.inf
    assert quality.rules_of(TREE) == {
        ((1, -inf, 0.5),), ((1, 0.5, inf),), ((1, 0.5, 0.2),), ((0, -inf, 7.0), (1, 0.5, inf)), ((0, 7.0, inf), (1, 0.5, inf)),
    }


def test_compiled_scores_equal_plain_python(spark):
    docs = table(spark, SF, "documents").limit(200)
    rows = quality.measured(docs.select("doc_id", "text"), "text")
    inf = math.inf
    model = quality.Ensemble(0.25, [(((0, 3.0, 6.0), (5, -inf, 0.1)), 1.5), (((4, 0.6, inf),), -2.0)])
    for r in rows.withColumn("score", model.score()).collect():
        m = [r[n] for n in quality.MEASURES]
        total = 0.25 + 1.5 * (3 < m[0] <= 6 and m[5] <= 0.1) - 2.0 * (m[4] > 0.6)
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-12


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.score(docs, labels, fold("doc_id", 3, 1)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    ranked = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    assert right > 0.95 and ranked > 0.97
    assert sum(r.predicted for r in rows if r.quality == 1) >= 0.98 * len(good)


def test_rules_are_few(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = quality.measured(docs.select("doc_id", "text"), "text").join(labels, "doc_id")
    model = quality.fit(rows, "quality")
    assert 1 <= len(model.rules) <= 100 and all(1 <= len(rule) <= quality.DEPTH for rule, _ in model.rules)


SCHEMA = "doc_id long, text string, score string, label string, _label int"


def test_odd_rows(spark):
    rows = [(None, "a b", "x", "y", 1), (1, None, "x", "y", 1), (2, "", "x", "y", 1), (3, " \n", "x", "y", 1), (4, "some words here", "x", "y", 1), (4, "some words here", "x", "y", 1), (5, "long " * 200_000, "x", "y", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(4, 1), (4, 1), (4, 0), (5, 0), (5, 1), (2, 7), (1, None), (None, 0)], "doc_id long, quality int")
    never = F.lit(False)
    got = quality.score(docs, labels, never).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {1.0}  # only one label teaches
    none = quality.score(docs, labels.limit(0), never).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.5, 1)}
    assert quality.score(docs.limit(0), labels, never).count() == 0
    two = spark.createDataFrame([(4, 1), (2, 0), (5, 0)], "doc_id long, quality int")
    got = quality.score(docs, two, never).collect()
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 4}) == 1
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1


def test_the_query(spark):
    df = queries.queries()["op12_quality"](spark, "/root/testdata/sf0.001")
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in ("doc_id", "held_out", "score", "predicted")} == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = df.collect()
    docs = {r.doc_id for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


@pytest.mark.parametrize("flip", [False, True])
def test_labels_of_held_rows_teach_nothing(spark, flip):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    held = fold("doc_id", 3, 1)
    changed = labels.withColumn("quality", F.when(held & F.lit(flip), 1 - F.col("quality")).otherwise(F.col("quality")))
    got = sorted((r.doc_id, round(r.score, 6)) for r in quality.score(docs, changed, held).collect())
    assert got == sorted((r.doc_id, round(r.score, 6)) for r in quality.score(docs, labels, held).collect())
