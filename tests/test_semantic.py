"""Anchors, scores, the calibration grid against a loop over cells, divergences, and selections that cover everything."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import filters, semantic
from tidemark.plans.adapter import orders_dataset


def test_anchors_are_validated(spark, tmp_path):
    good = {"debug": {"role": "semantic", "definition": "d", "examples": ["fix it", "broken"]}, "ops": {"role": "lexical", "definition": "o"}, "other": {"role": "fallback", "definition": "x"}}
    path = tmp_path / "anchors.json"
    path.write_text(json.dumps({"categories": good}))
    rows = {tuple(r) for r in semantic.read_anchors(spark, str(path)).collect()}
    assert rows == {("debug", "semantic", "d", "fix it"), ("debug", "semantic", "d", "broken"), ("ops", "lexical", "o", None), ("other", "fallback", "x", None)}
    wrong = [
        ({}, "no categories"), ({"nothing": good["ops"]}, "unknown"), ({"ops": {"role": "odd", "definition": "o"}}, "role"),
        ({"ops": {"role": "lexical"}}, "definition"), ({"debug": {"role": "semantic", "definition": "d", "examples": []}}, "examples"), ({"ops": None}, "role"),
    ]
    for categories, message in wrong:
        path.write_text(json.dumps({"categories": categories}))
        with pytest.raises(ValueError, match=message):
            semantic.read_anchors(spark, str(path))
    path.write_text("categories: [")
    with pytest.raises(ValueError, match="JSON"):
        semantic.read_anchors(spark, str(path))


def unit(r, d=5):
    v = r.standard_normal(d)
    return (v / np.linalg.norm(v)).tolist()


def test_scores_and_grid_equal_a_loop(spark):
    r, rr = np.random.default_rng(1), random.Random(1)
    protos = [(c, unit(r)) for c in ("debug", "test", "plan") for _ in range(3)]
    cases = [(i, unit(r), rr.choice(["debug", "test", "ops", "other", "followup", None]), rr.choice(["debug", "other"]), rr.choice([0.0, 0.6, 0.84]), rr.choice([None, None, None, "followup"])) for i in range(150)]
    cases += [(200, None, "other", "other", 0.0, None), (201, [1.0], "ops", "ops", 0.9, None), (202, [None, 1.0, 0.0, 0.0, 0.0], "other", "x", 0.0, None)]
    rows = spark.createDataFrame(cases, "i int, v array<double>, gold string, judge string, e double, short string")
    got, names = semantic.scored(rows, spark.createDataFrame(protos, "category string, vector array<double>"), "v", top=2)
    assert names == ["debug", "plan", "test"]
    scores = {x.i: x.scores for x in got.collect()}
    for i, v, *_ in cases:
        if v is None or len(v) != 5 or None in v:
            assert scores[i] is None
            continue
        for n, s in zip(names, scores[i], strict=True):
            assert abs(s - np.mean(sorted(np.dot(v, p) for c, p in protos if c == n)[-2:])) < 1e-12

    def label(case, tau, prime):
        i, _, _, _, e, short = case
        if short:
            return short
        values = dict(zip(names, scores[i] or [], strict=False)) | ({"ops": e * prime} if e > 0 else {})
        order = ("debug", "test", "ops", "plan")
        best = max(values.values(), default=-2)
        return next((n for n in order if values.get(n) == best), "other") if best >= tau else "other"

    grid = semantic.calibrate(got, names, "scores", {"ops": F.col("e")}, F.col("short"), "gold", "judge").collect()
    assert len(grid) == 77 and sum(x.chosen for x in grid) == 1
    counted = [c for c in cases if c[2] is not None]
    for x in grid:
        assert x.cases == len(counted)
        assert x.hits == sum(label(c, x.tau, x.prime) == c[2] for c in counted) and x.judge_hits == sum(label(c, x.tau, x.prime) == c[3] for c in counted)
    best = max(grid, key=lambda x: (x.hits, x.judge_hits, x.tau, -x.prime))
    assert best.chosen == 1
    empty = semantic.calibrate(got.limit(0), names, "scores", {}, F.col("short"), "gold").collect()
    assert {(x.hits, x.judge_hits, x.cases) for x in empty} == {(0, 0, 0)} and [(x.tau, x.prime) for x in empty if x.chosen] == [(0.45, 0.4)]


def test_divergences(spark):
    was = spark.createDataFrame([("a", "other"), ("b", "other"), ("c", "debug"), ("d", "debug"), ("e", "test"), ("f", "other")], "prompt_id string, category string")
    now = spark.createDataFrame([("a", "test"), ("b", "plan"), ("c", "test"), ("d", "debug"), ("e", "other"), ("f", "docs")], "prompt_id string, category string")
    texts = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "w"), ("f", "v")], "prompt_id string, text string")
    rows = sorted(map(tuple, semantic.divergences(was, now, texts).collect()))
    assert rows == [("contradiction", 0, "y", "debug", "test"), ("reclassified", 0, "x", "other", "test"), ("reclassified", 1, "v", "other", "docs")]
    assert semantic.divergences(was, now, texts, most=1).count() == 2


def test_a_selection_of_everything_keeps_blank_values(spark):
    ds = orders_dataset(spark, "/root/testdata/sf0.001")
    projects = [r[0] for r in filters.options(ds.prompts, "project").collect()]
    models = [r[0] for r in filters.options(ds.prompts, "model").collect()]
    assert "" not in projects and projects == sorted(projects) and ds.prompts.where("project = ''").count() and ds.prompts.where("model is null").count()
    n = ds.prompts.count()
    for chosen in (None, [], projects, [*projects, "more"]):
        assert filters.apply_filters(ds, projects=chosen, models=models).prompts.count() == n
    assert filters.apply_filters(ds, projects=projects[1:]).prompts.count() == ds.prompts.where(F.col("project").isin(projects[1:])).count() < n
    assert filters.apply_filters(ds, models=models[:1]).prompts.where("model is null").count() == 0
