import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from tidemark.llm import bpe
from tidemark.llm.queries import RANKS

EN = "the cat and the dog went to the house of the king and they were there for the whole of the day "
FR = "le chat et le chien sont dans la maison du roi et ils sont pour la plupart avec les enfants de la ville "


def documents(spark):
    text = lambda i: " ".join(random.Random(i).choices((EN if i % 2 else FR).split(), k=40 + i))
    rows = [(i, text(i), "en" if i % 2 else "fr", f"s{i % 3}", 0) for i in range(30)]
    rows += [(100, rows[3][1], "en", "s1", 0), (101, rows[3][1], "fr", "s2", 0), (102, "12 34 !!", "en", "s0", 0)]
    rows += [(103, None, "en", "s0", 0), (104, EN + "token = 'abcdefghijklmnop' end", "en", "s0", 0), (5, rows[5][1], "en", "s2", 0)]
    rows += [(None, "nobody knows this number at all " + EN, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), rows


def test_each_stage_does_its_work(spark):
    docs, rows = documents(spark)
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, "")
    assert one.columns == docs.columns
    got = {(r.doc_id, r.lang) for r in one.collect()}
    assert {i for i, _ in got} == {r[0] for r in rows} - {102, 103}
    assert (101, "en") in got and (0, "fr") in got and (None, "en") in got
    two = stage["near_duplicates"](spark, one, "")
    assert two.columns == docs.columns
    kept = Counter(r.doc_id for r in two.collect())
    assert kept[3] == kept[5] == kept[None] == 1 and not kept[100] and not kept[101]
    three = stage["secrets"](spark, two, "")
    texts = {r.doc_id: r for r in three.collect()}
    assert texts[104].text == EN + "[REDACTED]' end" and texts[104].n_chars == len(texts[104].text)
    assert texts[3].text == rows[3][1] and Counter(r.doc_id for r in three.collect()) == kept
    four = stage["mixing"](spark, three, "")
    assert four.columns == docs.columns
    times = Counter(r.doc_id for r in four.collect())
    assert times and max(times.values()) <= 3 and times.keys() <= kept.keys()
    five = stage["byte_bpe"](spark, four, "").collect()
    assert Counter(r.doc_id for r in five) == times
    ranks = bpe.codec(RANKS, public_tokenizers.PATTERN).ranks
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in five:
        assert r.ids == plain.encode_ordinary(texts[r.doc_id].text) and r.n_tokens == len(r.ids)


def test_run_applies_all_stages(spark, tmp_path):
    docs, _ = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() > 10
    empty = tmp_path / "empty"
    docs.limit(0).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


NAMES = ["lang_pred", "score", "stays", "odd", "row", "masks", "_0", "_1", "_k", "_t", "_masks", "s", "size", "hash", "copies", "threshold", "ids", "n_tokens", "node", "Cluster"]


def test_stages_pass_on_columns_of_any_name(spark):
    docs, rows = documents(spark)
    docs = docs.selectExpr("*", *(f"'{c}!' as `{c}`" for c in NAMES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *NAMES], name
        found = docs.collect()
        assert found and all(r[c] == f"{c}!" for r in found for c in NAMES), name
        docs = spark.createDataFrame(found, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(found)


def test_without_labels_documents_with_a_letter_stay(spark):
    docs, rows = documents(spark)
    bare = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    got = [r.doc_id for r in corpus_pipeline.language_id(spark, bare, "").collect()]
    assert sorted(map(str, got)) == sorted(str(r[0]) for r in rows if r[0] not in (102, 103))


def test_near_copies_go(spark):
    words = [f"w{i * i % 311}" for i in range(300)]
    rows = [(i, " ".join(w if j % 150 != 17 * i % 150 else "edited" for j, w in enumerate(words)), "en", "s", 0) for i in range(6)]
    rows.append((50, " ".join(f"v{i * i % 311}" for i in range(300)), "en", "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 50]
