import random

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.graph import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    at = list(range(len(prints)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return [root(i) for i in range(len(prints))]


TEXTS = [None, "", " \n\t", "one", "One  two", "a b c d", "A B\tC d", "a b c d e", "É é è", "x y z", "a\x1cb c d e f"]


def test_fingerprints_equal_the_definition():
    texts = [*TEXTS, " ".join(random.Random(1).choices("abcdefg", k=5000))]
    got = simhash.fingerprints_of([(t or "").encode() for t in texts], 4)[:, 0]
    assert [int(x) & (1 << 64) - 1 for x in got] == [brute_fingerprint(t) for t in texts]


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    text = " ".join(random.Random(2).choices("abcdefghij", k=100))
    assert int(simhash.fingerprints_of([text.encode(), b"q", text.encode()], 4)[2, 0]) & (1 << 64) - 1 == brute_fingerprint(text)


def _chains(seed, n):
    r = random.Random(seed)
    out = [r.getrandbits(64) for _ in range(n)]
    for _ in range(3 * n):
        x = r.choice(out)
        for _ in range(r.randint(1, 5)):
            x ^= 1 << r.randrange(64)
        out.append(x)
    return out


def test_components_equal_brute_force(spark):
    prints = sorted(set(_chains(3, 120) + [0, (1 << 64) - 1]))
    signed = [int(np.array(p, np.uint64).view(np.int64)) for p in prints]
    want = brute_components(prints)
    frame = spark.createDataFrame([(x,) for x in signed], "simhash long")
    for groups, block in ((6, 4096), (8, 4096), (5, 8)):
        pairs = components(simhash.links(frame, 4, groups, block)).collect()
        root = {r[0]: r[1] for r in pairs}
        got = [root.get(s, s) for s in signed]
        assert len(set(got)) == len(set(want))
        assert len({*zip(got, want, strict=True)}) == len(set(want))


def test_large_cells_connect_without_all_pairs():
    r = random.Random(4)
    near = sorted({0b1 << r.randrange(64) | 0b1 << r.randrange(64) for _ in range(600)})
    assert len(near) > simhash.SMALL_CELL
    a, b = simhash.cell_edges(np.array(near, np.uint64)[:, None], np.zeros(len(near), np.int64), 4)
    assert len(a) == len(near) - 1


def test_small_cells_connect_without_all_pairs():
    prints = np.array([0, 1, 3, 7, 1 << 60, 0xFF << 20, 0, 1], np.uint64)[:, None]
    a, b = simhash.cell_edges(prints, np.array([0] * 6 + [1] * 2), 4)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (0, 2), (0, 3), (0, 4), (6, 7)]


def test_more_fingerprints_get_more_groups():
    found = [simhash.groups_for(n, 4) for n in (1, 10**5, 10**9, 10**11)]
    assert found == sorted(found) and found[0] == 6 and found[-1] > found[0]


def shingles(text, n=5):
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def edited(r, text, changes):
    words = text.split()
    for at in r.sample(range(len(words)), changes):
        words[at] = words[at].upper() + "q" if r.random() < 0.7 else ""
    return " ".join(words)


def test_similar_texts_are_linked_and_others_are_not(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijkl", k=r.randint(1, 4)))
    vocabulary = [word() for _ in range(800)]
    texts, pairs = [], []
    for _ in range(150):
        text = " ".join(r.choices(vocabulary, k=r.randint(80, 400)))
        texts += [text, edited(r, text, max(1, int(len(text.split()) * r.uniform(0.005, 0.02))))]
        pairs.append((len(texts) - 2, len(texts) - 1))
    texts += [" ".join(r.choices(vocabulary, k=r.randint(5, 400))) for _ in range(200)]
    found = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    close = [(a, b) for a, b in pairs if len(shingles(texts[a]) & shingles(texts[b])) >= 0.8 * len(shingles(texts[a]) | shingles(texts[b]))]
    assert len(close) > 100
    assert sum(found[a] == found[b] for a, b in close) >= 0.9 * len(close)
    assert len(set(found.values())) >= len(texts) - len(pairs)  # nothing else is linked


def test_a_large_group_of_similar_texts_is_one(spark):
    r = random.Random(8)
    base = " ".join(r.choices([f"w{i}" for i in range(500)], k=300))
    rows = [(i, edited(r, base, 2)) for i in range(300)] + [(1000, " ".join(r.choices([f"v{i}" for i in range(500)], k=300)))]
    found = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component_id").count().collect()
    assert sorted(map(tuple, found)) == [(0, 300), (1000, 1)]


CLASHES = ["stays", "odd", "row", "id", "node", "cluster", "component_id", "of", "least", "cell", "print0", "_0", "_1", "simhash", "count"]


def test_one_of_each_group_stays_whatever_other_columns_there_are(spark):
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHES)
    text, other = "one two three four five six seven", "quite another text of seven words here"
    row = lambda i, t, x: (i, t, *[x] * len(CLASHES))
    plain = [row(2, text, "b"), row(1, text, "a"), row(3, other, "c"), row(9, None, "n"), row(8, "", "e")]
    got = simhash.keep_one(spark.createDataFrame(plain, schema))
    assert got.columns == ["doc_id", "text", *CLASHES]
    assert sorted((r.doc_id, r.text, r.stays, r.count_ if hasattr(r, "count_") else r["count"]) for r in got.collect()) == [(1, text, "a", "a"), (3, other, "c", "c"), (8, "", "e", "e")]
    repeated = plain + [row(1, text, "z"), row(1, other, "y"), row(None, other, "x"), row(None, "nothing like it", "w"), row(None, "nothing like it", "v")]
    for _ in range(2):
        kept = simhash.keep_one(spark.createDataFrame(repeated, schema).repartition(3)).collect()
        assert sorted((str(r.doc_id), r.text, r.stays) for r in kept) == sorted([("1", text, "a"), ("1", other, "y"), ("8", "", "e"), ("None", "nothing like it", "v")])


def test_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b c d", "y"), (5, "a b c d", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, simhash string")
    got = simhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    roots = brute_components(prints)
    least = {}
    for (i, _, _), root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, 1 << 40), i if i is not None else 1 << 40)
    want = sorted((str(i), p, least[root]) for (i, _, _), p, root in zip(rows, prints, roots, strict=True))
    assert sorted((str(r[0]), r[1] & (1 << 64) - 1, r[3]) for r in got) == want
    assert simhash.near_duplicates(frame.limit(0)).count() == 0
