"""That the joins and the splits of the attribution are in different stages, so that a task holds the sorts of one of them."""

from __future__ import annotations

import contextlib
import io

from tidemark.operators import apportion


def test_loads_are_dealt_anew_between_join_and_splits(spark):
    requests = "session_id string, prompt_id string, turn int, model string, post_compact int, cache_read_tokens bigint, cache_write_5m_tokens bigint, cache_write_1h_tokens bigint"
    elements = "session_id string, prompt_id string, ordinal bigint, source string, language string, path string, tokens bigint"
    out = apportion.attribute(
        spark.createDataFrame([("s", "p", 1, "m", 0, 10, 7, 0)], requests), spark.createDataFrame([("s", "p", 1, "file_read", "-", "a", 1), ("s", "p", 2, "file_read", "-", "b", 1)], elements)
    )
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        out.explain()
    assert any("hashpartitioning(session_id" in x and "turn" in x and "REPARTITION_BY_NUM" in x for x in plan.getvalue().splitlines())
    got = {r["path"]: (r["rent_read_tokens"], r["load_write_5m_tokens"]) for r in out.collect()}
    assert got == {"a": (5, 4), "b": (5, 3)}
