"""Spelling variants by two-dimensional range reporting in wavelet trees (operator 11).

Words are maximal runs of Latin letters (A-Z, a-z and U+00C0 to U+00FF, so one byte each), counted over all texts. Two words
are near if one inserted, deleted or replaced letter makes them equal. Of a word and an edit position the near words are those that share the
letters before the position and the letters after it: an interval of the words in forward order and one in the order of
the reversed words. A word is a point (place in forward order, place in reverse order); a wavelet tree over the points reports those in both
intervals. One tree holds the words as long as the word (replacements), one those longer by a letter (insertions; seen from the longer
word they are deletions).

Words are dealt out so that no task sees more than a bounded part. A word of length n is in class n, as the shorter or equal word of a
pair, and in class n - 1, as the longer one. The edit positions of a class are cut into windows; within a window near words
share all letters before it and after it, and the hash of those is their key. A key that holds more than ``CROWD`` letters has
its window halved, until no key does or its window is one position (then a key holds what differs in one or two letters only). So
every pair meets exactly once whatever the words are, and nothing is cut off. Keys are packed into shards of about ``SHARD`` letters.

A word's form is its near word of most occurrences, ties to the first by code point, if it occurs ``RATIO`` times as often; the root follows forms to the
last one by pointer doubling, so that a chain of d forms takes log2(d) joins.

Defined results: a null text has no words; a null id counts as ''; other letters than those named end a run; repeated rows count each;
shorter words than ``LETTERS`` and rarer ones than ``LEAST`` are no words; without any word the result is empty; other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import steps
from tidemark.llm.common import cut, key_text

LETTERS, LEAST, RATIO = 7, 2, 10
#: Of so many occurrences, by hash, one loses a letter.
SLIP = 31
CROWD, SHARD = 1 << 16, 1 << 18
FLUSH = 1 << 18  # distinct words that a task counts before it sends them on
QUERIES = 1 << 20  # (word, position) pairs that are looked up at once
FEW = 10_000


def runs(letters: int) -> re.Pattern[bytes]:
    return re.compile(rb"[A-Za-z\xc0-\xff]{%d,}" % letters)


def slipped(run: bytes, seed: int) -> bytes:
    """``run``, without one letter if its hash says so; ``seed`` is the crc32 of what precedes the run in the hashed text."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST) -> DataFrame:
    """(word, n) over all texts, of words of ``letters`` letters and ``least`` occurrences at least."""
    found = runs(letters)

    def rows(counts: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in counts], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for part in steps(batch, "_text"):
                for key, t in zip(part.column("_id").to_pylist(), part.column("_text").to_pylist(), strict=True):
                    if not t:
                        continue
                    seed = zlib.crc32(f"{key}:".encode())
                    for word, n in Counter(found.findall(t.encode("latin-1", "replace").lower())).items():
                        if len(word := slipped(word, seed)) >= letters:
                            total[word] += n
                    if len(total) >= FLUSH:
                        yield rows(total)
                        total = Counter()
        yield rows(total)

    inner = docs.select(key_text(id_col).alias("_id"), F.col(text).alias("_text"))
    return inner.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class WaveletTree:
    """A permutation, level by level: on each, the elements' current bit, zeros before ones, and how many ones precede each place."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for shift in range(max(0, (len(values) - 1).bit_length() - 1), -1, -1):
            bit = (values >> shift) & 1
            self.levels.append((shift, np.concatenate(([0], np.cumsum(bit))), len(values) - int(bit.sum())))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all values in [least, most) at the places [lo, hi), for many queries at once."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        keep = (lo < hi) & (least < most)
        query, lo, hi, value = query[keep], lo[keep], hi[keep], value[keep]
        for shift, ones, zeros in self.levels:
            a, b = ones[lo], ones[hi]
            query, value = np.concatenate((query, query)), np.concatenate((value, value + (1 << shift)))
            lo, hi = np.concatenate((lo - a, zeros + a)), np.concatenate((hi - b, zeros + b))
            keep = (lo < hi) & (value < most[query]) & (value + (1 << shift) > least[query])
            query, lo, hi, value = query[keep], lo[keep], hi[keep], value[keep]
        return query, value


class Order:
    """Words of two lengths in the order of their letters, and the intervals of those that share a beginning."""

    def __init__(self, words: np.ndarray):
        self.by = np.argsort(words, kind="stable")
        self.place = np.empty(len(words), np.int64)
        self.place[self.by] = np.arange(len(words))
        letters = words[self.by].view(np.uint8).reshape(len(words), -1)
        differ = letters[1:] != letters[:-1]
        self.shared = np.concatenate(([-1], np.where(differ.any(axis=1), differ.argmax(axis=1), letters.shape[1])))

    def interval(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For the words at the places ``at``, the first place and the one after the last that share ``length`` letters."""
        starts = np.append(np.flatnonzero(self.shared < length), len(self.shared))
        i = np.searchsorted(starts, at, "right") - 1
        return starts[i], starts[i + 1]


class Points:
    """Some of the words as points of both orders, in a wavelet tree."""

    def __init__(self, forward: Order, reverse: Order, member: np.ndarray):
        self.before = [np.concatenate(([0], np.cumsum(member[o.by]))) for o in (forward, reverse)]
        inside = forward.by[member[forward.by]]
        self.words = reverse.by[member[reverse.by]]  # by their value in the tree
        self.tree = WaveletTree(self.before[1][reverse.place[inside]])

    def meet(self, first: tuple, second: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of the words that are in the forward interval ``first`` and in the reverse interval ``second``."""
        lo, hi = (self.before[0][x] for x in first)
        least, most = (self.before[1][x] for x in second)
        query, value = self.tree.report(lo, hi, least, most)
        return query, self.words[value]


def near_words(words: list[bytes], length: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (shorter or equal, other) of ``words``, ``length`` or one more letters each, that one edit at a position in
    [first, last) makes equal. A replacement is found from both sides; an insertion that several positions allow, at the last one."""
    given = np.array(words, f"S{length + 1}")
    size = np.fromiter(map(len, words), np.int64, len(words))
    forward, reverse = Order(given), Order(np.array([w[::-1] for w in words], f"S{length + 1}"))
    short = np.flatnonzero(size == length)
    letters = given.view(np.uint8).reshape(len(words), -1)
    same, longer = Points(forward, reverse, size == length), Points(forward, reverse, size == length + 1)
    out = [(np.array([], np.int64),) * 2]
    step = max(1, QUERIES // max(1, len(short)))
    for start in range(first, last, step):
        for points, extra in ((same, 1), (longer, 0)):
            positions = [i for i in range(start, min(last, start + step)) if i + extra <= length]
            if not positions or not len(short) or not len(points.words):
                continue
            begins = [forward.interval(forward.place[short], i) for i in positions]
            ends = [reverse.interval(reverse.place[short], length - i - extra) for i in positions]
            joined = [tuple(np.concatenate([x[k] for x in side]) for k in (0, 1)) for side in (begins, ends)]
            query, other = points.meet(*joined)
            word, at = short[query % len(short)], np.array(positions)[query // len(short)]
            if extra:
                keep = word != other
            else:
                keep = (at == length) | (letters[word, np.minimum(at, length - 1)] != letters[other, at])
            out.append((word[keep], other[keep]))
    return tuple(np.concatenate([x[k] for x in out]) for k in (0, 1))


def _window(first: Column, last: Column, length: Column) -> Column:
    """The key of a word in a window of a class: a hash of the letters before and after the window."""
    tail = F.greatest(length - last, F.lit(0))
    head = F.substring(F.col("word"), F.lit(1), first)
    end = F.when(tail > 0, F.substring(F.col("word"), F.length("word") - tail + 1, tail)).otherwise("")
    return F.xxhash64(length, first, last, head, end)


def windows(words: DataFrame, crowd: int | None = None) -> DataFrame:
    """(word, n, length, first, last, key): every word in its two classes, in windows whose keys hold ``crowd`` letters at most."""
    crowd = crowd or CROWD
    own = F.length("word")
    classes = F.explode(F.array(own, own - 1))
    half = F.col("length").cast("int") + 1
    rows = words.select("word", "n", classes.alias("length"))
    cuts = F.array(F.struct(F.lit(0).alias("first"), F.floor(half / 2).cast("int").alias("last")), F.struct(F.floor(half / 2).cast("int").alias("first"), half.alias("last")))
    rows = rows.select("word", "n", "length", F.inline(cuts)).withColumn("key", _window(F.col("first"), F.col("last"), F.col("length")))
    # a class without words of its own length has no pairs
    rows, done = cut(rows), []
    while True:
        by = ["length", "first", "last", "key"]
        sizes = rows.groupBy(*by).agg((F.count("*") * F.first("length")).alias("letters"), F.count_if(F.length("word") == F.col("length")).alias("shorter"), F.count("*").alias("members"))
        sizes = sizes.where((F.col("shorter") > 0) & (F.col("members") > 1))
        sizes = cut(sizes.select(*by, ((F.col("letters") > crowd) & (F.col("last") - F.col("first") > 1)).alias("crowded")))
        rows = rows.join(sizes, by)
        done.append(rows.where(~F.col("crowded")).drop("crowded"))
        if sizes.where("crowded").limit(1).count() == 0:
            break
        middle = F.floor((F.col("first") + F.col("last")) / 2).cast("int")
        halves = F.inline(F.array(F.struct(F.col("first").alias("_a"), middle.alias("_b")), F.struct(middle.alias("_a"), F.col("last").alias("_b"))))
        rows = rows.where("crowded").select("word", "n", "length", halves)
        rows = rows.select("word", "n", "length", F.col("_a").alias("first"), F.col("_b").alias("last"), _window(F.col("_a"), F.col("_b"), F.col("length")).alias("key"))
        rows = cut(rows)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("word", "n", "length", "first", "last", "key")


def sharded(rows: DataFrame, shard: int | None = None) -> DataFrame:
    """``rows`` with ``part``: keys of a class and window are dealt to as many parts as its letters need."""
    rows = cut(rows)
    sizes = rows.groupBy("length", "first", "last").agg(F.ceil(F.count("*") * F.first("length") / F.lit(shard or SHARD)).cast("long").alias("parts"))
    sizes = cut(sizes)
    few = F.broadcast(sizes) if sizes.limit(FEW + 1).count() <= FEW else sizes
    return rows.join(few, ["length", "first", "last"]).withColumn("part", F.pmod("key", "parts")).drop("key", "parts")


NEAR = "word string, n_near long, best_n long, best string"


def near_in_shard(table: pa.Table) -> pa.Table:
    """For each word of a shard that has near words there: how many, and the most frequent one."""
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    length, first, last = (table.column(c)[0].as_py() for c in ("length", "first", "last"))
    n = table.column("n").to_numpy()
    a, b = near_words(words, length, first, last)
    longer = np.fromiter(map(len, words), np.int64, len(words))[b] > length if len(words) else np.array([], bool)
    word, other = np.concatenate((a, b[longer])), np.concatenate((b, a[longer]))
    place = Order(np.array(words, f"S{length + 1}")).place
    order = np.lexsort((place[other], -n[other], word))
    word, other = word[order], other[order]
    starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.array([], np.int64)
    text = [w.decode("latin-1") for w in words]
    return pa.table({
        "word": pa.array([text[i] for i in word[starts]], pa.string()), "n_near": pa.array(np.diff(np.append(starts, len(word))), pa.int64()),
        "best_n": pa.array(n[other[starts]], pa.int64()), "best": pa.array([text[i] for i in other[starts]], pa.string()),
    })


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form): the last of the forms that follow; there is no cycle."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        now = cut(now.join(further, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        if now.where("_moved").limit(1).count() == 0:
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row (word, n); words are distinct runs of Latin letters in lower case."""
    words = cut(words)
    by = ["length", "first", "last", "part"]
    pairs = sharded(windows(words)).groupBy(*by).applyInArrow(near_in_shard, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    near = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left").withColumn("_is", -F.col("best.less") >= ratio * F.col("n"))
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_is"), F.col("best.word")).alias("form"),
        F.when(F.col("_is"), -F.col("best.less")).cast("long").alias("form_n"),
    )
    found = cut(found)
    last = roots(found.where(F.col("form").isNotNull()))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
