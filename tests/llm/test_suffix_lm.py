import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import suffix_lm
from tidemark.llm.common import fold

VOCABULARY = ["the", "The", "of", "a", "b", "é", "x\x1cy", "q", "r", "s"]


def corpus(n=120, seed=0):
    r = random.Random(seed)
    docs = []
    for i in range(n):
        words = [r.choice(VOCABULARY)]
        for _ in range(r.randrange(60)):
            words.append(r.choice(VOCABULARY[:3]) if words[-1] == "of" else r.choice(VOCABULARY) if r.random() < 0.7 else words[-1])
        docs.append((i, r.choice([" ", "\n", "  "]).join(words)))
    return docs + [(900, None), (901, ""), (902, "never seen words the of a"), (None, "the of"), (3, docs[3][1])]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def tokens_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + [""]


class Brute:
    """The same tree straight from the definition."""

    def __init__(self, docs, depth, least):
        self.counts = Counter()
        training = [tokens_of(t) for i, t in docs if not held(i)]
        for words in training:
            for d in range(1, depth + 2):
                self.counts.update(tuple(words[i : i + d]) for i in range(len(words) - d + 1))
        self.n = sum(map(len, training))
        self.v = sum(1 for s in self.counts if len(s) == 1)
        self.often = {s: c for s, c in self.counts.items() if c >= least}
        self.kept = {}
        for d in range(1, depth + 1):
            for s in [s for s in self.often if len(s) == d and s[-1]]:
                self.decide(s)

    def after(self, s):
        return {t[-1]: c for t, c in self.often.items() if t[:-1] == s}

    def decide(self, s):
        found, c = self.after(s), self.often[s]
        if not found or (len(s) > 1 and s[1:] not in self.kept):
            return
        q = {w: self.p(s[1:], w) for w in found}
        apart = sum(n / c * math.log(n / c / q[w]) for w, n in found.items())
        rest, rest_q = 1 - sum(found.values()) / c, max(1 - sum(q.values()), 1e-12)
        apart += rest * math.log(rest / rest_q) if rest > 1e-15 else 0
        if apart >= suffix_lm.DIVERGENCE and 2 * c * apart >= suffix_lm.SIGNIFICANT:
            self.kept[s] = max(1 - sum(n - suffix_lm.DISCOUNT for n in found.values()) / c, 1e-12) / rest_q

    def p(self, s, w):
        if not s:
            return (self.counts[(w,)] + 1) / (self.n + self.v + 1)
        if s not in self.kept:
            return self.p(s[1:], w)
        found = self.after(s)
        return (found[w] - suffix_lm.DISCOUNT) / self.often[s] if w in found else self.kept[s] * self.p(s[1:], w)


@pytest.mark.parametrize("block", [64, 1 << 22])
def test_scores_equal_brute_force(spark, block):
    docs, depth = corpus(), 2
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(3)
    got = suffix_lm.score(frame, fold("doc_id", 7, 2), depth=depth, block_tokens=block).collect()
    brute = Brute(docs, depth, suffix_lm.LEAST)
    assert len(got) == len(docs) and len(brute.kept) > 5 and any(len(s) == 2 for s in brute.kept)
    key = lambda r: (str(r[0]), r[1])
    by = {}
    for i, t in docs:
        by.setdefault(i, tokens_of(t))
    for r in sorted(got, key=key):
        words = by[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(words), brute.n)
        assert r.n_known == sum(brute.counts[(w,)] > 0 for w in words)
        assert r.base_score == pytest.approx(sum(math.log10(brute.p((), w)) for w in words), rel=1e-9)
        want = 0
        for k, w in enumerate(words):
            s = tuple(words[max(0, k - depth) : k])
            want += math.log10(brute.p(s, w))
        assert r.score == pytest.approx(want, rel=1e-9)


def test_distributions_sum_to_one():
    brute = Brute(corpus(), 2, suffix_lm.LEAST)
    known = [s[0] for s in brute.counts if len(s) == 1]
    for s in brute.kept:
        assert sum(brute.p(s, w) for w in [*known, "unknown"]) == pytest.approx(1, abs=1e-9)


def test_arrays_survive_packing():
    for x in (np.array([], np.int32), np.arange(-5, 900, dtype=np.int32), np.array([1 << 60, 0], np.int64)):
        assert suffix_lm.unpacked(suffix_lm.packed(x)).tolist() == x.tolist()
    keys = np.array([3, 9, 1 << 40], np.int64)
    assert suffix_lm.unpacked_keys(suffix_lm.packed_keys(keys)).tolist() == keys.tolist()


def test_empty_inputs(spark):
    frame = spark.createDataFrame([(2, "a b")], "doc_id long, text string")
    from pyspark.sql import functions as F

    only_held = suffix_lm.score(frame, F.lit(True)).first()
    assert (only_held.n_known, only_held.train_tokens, only_held.base_score, only_held.score) == (0, 0, 0.0, 0.0)
    assert suffix_lm.score(frame.limit(0), fold("doc_id", 7, 2)).count() == 0


def test_frequency_does_not_depend_on_corpus_size(spark):
    r = random.Random(1)
    docs = [(i, " ".join(f"w{r.randrange(3000)}" for _ in range(6000))) for i in range(100)]
    passage = " ".join(f"p{i}" for i in range(40))
    docs += [(1000 + i, passage) for i in range(12)]  # 515,000 training tokens: at 1e-5 of them a sequence needs 6 occurrences
    few = [i for i, t in docs if t == passage and not held(i)][4:]
    docs = [(i, t) for i, t in docs if i not in few]
    got = suffix_lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), fold("doc_id", 7, 2)).collect()
    assert got[0].train_tokens > 500_000
    for x in (x for x in got if x.doc_id >= 1000):
        assert x.score > x.base_score / 3


def test_nothing_is_left_behind_when_a_step_fails(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "some words here") for i in range(5)], "doc_id long, text string")

    def fails(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(suffix_lm, "word_counts", fails)
    with pytest.raises(RuntimeError, match="lost"):
        suffix_lm.score(docs, F.lit(False))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("suffix_blocks_")]


def test_slices_of_a_block_score_as_the_whole(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string").coalesce(1)
    score = lambda: sorted(tuple(r) for r in suffix_lm.score(frame.where("doc_id is not null"), fold("doc_id", 7, 2)).collect())
    whole = score()
    monkeypatch.setattr(suffix_lm, "SLICE_TOKENS", 50)
    assert score() == whole
    assert list(suffix_lm.document_slices(np.array([60, 20, 30, 1, 90]), 50)) == [(0, 1), (1, 3), (3, 5)]
