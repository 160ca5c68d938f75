from pyspark.sql import functions as F

from tidemark.llm import langid
from tidemark.llm.common import fold, table


def test_ngrams_of_parts_equal_those_of_the_whole(monkeypatch):
    text = "Déjà vu, 12 chats!! " * 50
    whole = langid.ngrams(text)
    monkeypatch.setattr(langid, "CHUNK", 7)
    parts = langid.ngrams(text)
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()
    grams = dict(zip(*map(lambda a: a.tolist(), langid.ngrams("aba")), strict=True))
    pad, a, b = langid.PAD, ord("a"), ord("b")
    join = lambda *c: sum(x << langid.BITS * i for i, x in enumerate(reversed(c)))
    assert grams == {a: 2, b: 1, join(pad, a): 1, join(a, b): 1, join(b, a): 1, join(a, pad): 1, join(pad, a, b): 1, join(a, b, a): 1, join(b, a, pad): 1}


def test_distance_equals_the_definition():
    text, length = "some words of some length", 20
    profiles = {"x": langid.ranked(langid.ngrams("some words"), length), "y": langid.ranked(langid.ngrams("autres mots"), length)}
    top = langid.ranked(langid.ngrams(text), length).tolist()
    total = {}
    for k, p in profiles.items():
        ranks = {g: i for i, g in enumerate(p.tolist())}
        total[k] = sum(abs(i - ranks[g]) if g in ranks else length for i, g in enumerate(top))
    label, score = langid.Classifier(profiles, length)(text)
    assert label == min(total, key=lambda k: (total[k], k)) and abs(score - (1 - total[label] / length / len(top))) < 1e-12


def test_held_out_accuracy_and_odd_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    held = fold("doc_id", 4, 2)
    profiles = langid.fit(docs, ~held, per_language=200)
    found = langid.identify(docs.select("doc_id", "lang", held.alias("held_out"), "text"), profiles, drop=("text",))
    assert "text" not in found.columns
    right = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.98 and 0 <= right[1] <= right[2] <= 1
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 !!", None), (4, "THE END OF IT", None), (4, "THE END OF IT", None)], "doc_id long, text string, lang_pred string")
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(odd, profiles).collect())
    assert got[:3] == [(1, "und"), (2, "und"), (3, "und")] and got[3] == got[4] and got[3][1] in profiles
    assert langid.fit(odd.limit(0).withColumn("lang", F.lit("")), F.lit(True)) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_null_and_repeated_ids_neither_hide_a_label_nor_exceed_the_bound(spark):
    rows = [(None, f"null ids share words {i} {chr(97 + i % 26)}", "xx") for i in range(20_000)]
    rows += [(i, f"andere worte {i}", "yy") for i in range(200)]
    rows += [(7, f"un identifiant commun {i}", "zz") for i in range(9000)] + [(8, "copie", "ww")] * 5000 + [(9, "unique", "ww")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    profiles = langid.fit(docs, F.lit(True), per_language=300)
    assert set(profiles) == {"xx", "yy", "zz", "ww"}
    sampled = docs.select("lang", F.xxhash64("doc_id", "text", F.lit(3)).alias("hash")).distinct().where(F.pmod("hash", F.lit(1 << 30)) < (1 << 30) * 300 / 20_000)
    assert sampled.where("lang = 'xx'").count() < 400
    whole = langid.fit(docs.where("lang = 'ww'"), F.lit(True))["ww"].tolist()
    found = {}
    for t, times in (("copie", 5000), ("unique", 1)):
        for g, n in zip(*(x.tolist() for x in langid.ngrams(t)), strict=True):
            found[g] = found.get(g, 0) + n * times
    assert whole == sorted(found, key=lambda g: (-found[g], g))[:400]
    assert langid.identify(spark.createDataFrame([("null ids share words",)], "text string"), profiles).first().lang_pred == "xx"


def test_labels_of_free_text_stay_bounded(spark):
    rows = [(i, "the same words", f"label {i}") for i in range(300)] + [(i, "frequent words", "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(docs, F.lit(True), most_labels=3)) == {"en", "label 0", "label 1"}
