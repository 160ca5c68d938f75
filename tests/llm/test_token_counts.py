import random

import numpy as np
import public_tokenizers

from tidemark.llm import bpe, token_counts
from tidemark.llm.queries import RANKS

PATTERN = public_tokenizers.PATTERN


def brute(token_sizes, section_sizes):
    owner = [s for s, n in enumerate(section_sizes) for _ in range(n)]
    counts, crossing, at = [0] * len(section_sizes), 0, 0
    for n in token_sizes:
        held = owner[at : at + n]
        crossing += len(set(held)) > 1
        counts[max(sorted(set(held)), key=held.count)] += 1
        at += n
    return counts, crossing


def test_attribution_equals_brute_force():
    r = random.Random(0)
    for _ in range(300):
        n = r.randrange(1, 60)
        cut = lambda most: np.diff(sorted({0, n, *(r.randrange(n) for _ in range(r.randrange(most)))}))
        tokens, sections = cut(40), list(cut(10))
        sections.insert(r.randrange(len(sections) + 1), 0)  # an empty section gets nothing
        got, crossing = token_counts.attribute(tokens, np.array(sections))
        assert (got.tolist(), crossing) == brute(tokens.tolist(), sections)


def test_lines_and_fields(spark):
    texts = [None, "", "one line", "a\n\nb\n", "\n\n\n", "é ü\nñ ñ", "x" * 5000 + "\ny"]
    frame = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    codec = bpe.codec(RANKS, PATTERN)
    for r in token_counts.by_lines(frame, RANKS, PATTERN).collect():
        ids = codec.core.encode_ordinary(texts[r.doc_id] or "")
        lines = [x.encode() for x in (texts[r.doc_id] or "").splitlines(keepends=True)]
        want, crossing = brute([len(codec.tokens[i]) for i in ids], [len(x) for x in lines])
        assert (r.n_tokens, r.section_tokens, r.n_crossing) == (len(ids), want, crossing)
    assert token_counts.by_lines(frame.limit(0), RANKS, PATTERN).count() == 0
    turns = spark.createDataFrame([(1, "user", None, "hello world"), (2, None, "", "")], "id long, role string, note string, text string")
    got = {r.id: r for r in token_counts.by_fields(turns, ["role", "note", "text"], RANKS, PATTERN).collect()}
    ids = codec.core.encode_ordinary("user\n\nhello world")
    want, crossing = brute([len(codec.tokens[i]) for i in ids], [5, 1, 11])
    assert (got[1].n_tokens, got[1].section_tokens, got[1].n_crossing) == (len(ids), want, crossing)
    assert got[1].note is None and sum(got[2].section_tokens) == got[2].n_tokens
    odd = spark.createDataFrame([(1, "user", "a b", "x"), (1, "user", "a b", "x")], "id long, role string, text string, joined string")
    both = token_counts.by_fields(odd.withColumnRenamed("joined", "__joined"), ["role", "text"], RANKS, PATTERN).collect()
    assert both[0] == both[1] and both[0]["__joined"] == "x" and len(both[0].section_tokens) == 2
    again = token_counts.by_fields(odd, ["role", "joined"], RANKS, PATTERN, drop=("text",))
    assert again.columns == ["id", "role", "joined", "n_tokens", "n_crossing", "section_tokens"] and again.first().joined == "x"
