"""The registered queries against their contract: columns, types, row sets, folds and ties."""

import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import langid, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def run(spark, name, wanted):
    df = queries.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in wanted} == wanted
    return df.collect()


def test_op1(spark):
    rows = run(spark, "op1_nearest", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append(r)
    assert by.keys() == {i for i in table if i % 20 == 0}
    found = 0
    for q, some in by.items():
        assert [r["rank"] for r in some] == list(range(1, 21)) and q not in {r.vec_id for r in some}
        assert some == sorted(some, key=lambda r: (-r.score, r.vec_id))
        assert all(r.score == float((table[r.vec_id] * table[q]).sum()) for r in some)
        best = sorted((-float((v * table[q]).sum()), i) for i, v in table.items() if i != q)[:20]
        found += len({i for _, i in best} & {r.vec_id for r in some})
    assert found >= 0.9 * 20 * len(by)


def test_op2(spark, docs):
    rows = run(spark, "op2_licenses", {"doc_id": "bigint", "path": "string", "licence": "string", "cosine": "double", "origin": "string", "inherited_from": "string"})
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        d = docs[r.doc_id]
        assert r.path == f"{d.source}/{d.lang or 'none'}/{r.doc_id // 50}/{r.doc_id}.txt"
        assert (r.origin == "own") == (r.cosine is not None) and (r.licence is None) == (r.origin == "none")


def test_op3(spark, docs):
    rows = run(spark, "op3_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    known = {d.lang for i, d in docs.items() if fold(i, 4) != 2 and d.lang is not None}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    right = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(right) >= 0.9 * len(right) > 0
    for r in rows:
        text = docs[r.doc_id].text
        assert r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text)) and r.lang_pred in known | {"und"}


def test_op3_profiles_equal_brute_force(spark):
    rows = [(i, f"ab ba{chr(97 + i % 5)} {'xy ' * (i % 3)}", "p" if i % 2 else "q") for i in range(40)] + [(90, "zz", None), (91, None, "p"), (92, "12", "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.fit(frame, frame.doc_id >= 0, length=12)
    want = {}
    for _, t, lang in rows:
        if lang and t and any(c.isalpha() for c in t):
            grams, counts = langid.ngrams(t)
            for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                want.setdefault(lang, {})[g] = want.get(lang, {}).get(g, 0) + n
    assert {k: v.tolist() for k, v in got.items()} == {k: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))][:12] for k, c in want.items()}
    tie = langid.Classifier({"b": np.array([5]), "a": np.array([5])})
    assert tie("unseen text")[0] == "a"


def test_op4(spark, docs):
    rows = run(spark, "op4_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
    least = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            low = min(least[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4)
            if low < least[i]:
                least[i], changed = low, True
    assert {r.doc_id: r.component_id for r in rows} == least


def test_op5(spark, docs):
    rows = run(spark, "op5_suffix_tree", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"})
    words = {i: [*(d.text or "").encode().lower().split(), b""] for i, d in docs.items()}
    counts = {}
    for i, some in words.items():
        for w in some if fold(i, 7) != 2 else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        some = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 7) == 2, len(some), sum(w in counts for w in some), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in some), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) >= sum(r.base_score for r in held) * 1.05


def test_op6_and_op10(spark, docs):
    import tiktoken

    from tidemark.llm import bpe

    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(queries.RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    ids = {i: plain.encode_ordinary(d.text or "") for i, d in docs.items()}
    rows = run(spark, "op6_byte_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256) == (len(ids[r.doc_id]), hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest()
    rows = run(spark, "op10_token_counts", {"doc_id": "bigint", "n_tokens": "bigint", "n_crossing": "bigint", "section_tokens": "array<bigint>"})
    assert sorted(r.doc_id for r in rows) == sorted(docs) and all(r.n_tokens == sum(r.section_tokens) == len(ids[r.doc_id]) for r in rows)


def test_op7(spark):
    rows = run(spark, "op7_maxscore", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"})
    table = {r.vec_id: np.floor(np.array(r.embedding, float) * 1024).astype(np.int64) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    want = []
    for q in (i for i in table if i % 100 == 0):
        best = sorted((-int(table[q] @ v), i) for i, v in table.items() if i != q)[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in rows) == sorted(want)


def test_op8_and_op9(spark, docs):
    rows = run(spark, "op8_secrets", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"})
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        base = [x for x in r.spans.split(",") if x and not x.startswith("literal")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
    rows = run(spark, "op9_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    assert {r.doc_id: r["size"] for r in rows} == {i: len((d.text or "").encode().split()) for i, d in docs.items()}
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    sums = {}
    for r in rows:
        s = sums.setdefault(docs[r.doc_id].source, [0, r.target, 0])
        s[0] += r.taken
        s[2] = max(s[2], r["size"])
    assert all(abs(taken - target) <= most for taken, target, most in sums.values())
