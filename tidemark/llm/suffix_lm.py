"""Language-model scores from a probabilistic suffix tree over words (operator 5).

Base: the unigram model with one added to every count and one unknown word. The tree adds contexts of one to ``depth``
words. A sequence counts as frequent if it occurs ``LEAST`` times in the training documents, whatever the corpus, so the
tree grows with it. All counts are taken over all training documents. A context is retained if its next-symbol distribution
diverges from that of its own longest retained suffix (Kullback-Leibler at least ``DIVERGENCE`` nats, and significant at
0.001 by the G-test). Frequent continuations of a retained context have their discounted relative frequency; the mass
left goes to all other symbols in proportion to the suffix's distribution, and so on to the base, so that every
distribution sums to one. Each token is scored in the state of the longest retained suffix of what precedes it in its
document.

Nothing of the tree comes to the driver or is broadcast: frequent sequences, divergence tests and retained states are
tables by key. A block of documents asks for its distinct sequences by hash bucket, one length after the other (only those
whose two parts are frequent), and last for the probabilities of the frequent ones.

Corpus words are counted without sending each token through a shuffle. Documents are read once into blocks of
``BLOCK_TOKENS`` tokens with a vocabulary of their own; a block asks for its distinct words' counts by hash bucket and
gets them back. Blocks are a table bucketed by their number, so that the replies come to them and tokens are never
shuffled; the table lies in the shared folder and is removed when the scores are written. Words and sequences are known by 64-bit hashes: V of them are confused with a probability below V²/2^65.

Defined results: a null text is the empty text, whose only token is the end; nothing to learn from makes every
probability of the base 1 (N = V = 0); repeated rows are counted each and score equally; a null id counts as '' for the
folds; ids are integers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gc
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import steps, utf8
from tidemark.llm.common import cut, shared_folder

LEAST = 4
DEPTH, DISCOUNT, DIVERGENCE, SIGNIFICANT = 3, 0.5, 0.01, 10.83
BLOCK_TOKENS = 1 << 20
#: Blocks get their probabilities in so many rounds, so that what they ask and are told needs that part of the disk.
ROUNDS = 2
#: Tokens of a block that are scored at once.
SLICE_TOKENS = 1 << 17
END = b""  # no word is empty

_codec = pa.Codec("zstd", 1)


def packed(x: np.ndarray) -> bytes:
    """An integer array, its bytes plane by plane, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + x.dtype.str[1:].encode() + (_codec.compress(planes, asbytes=True) if len(x) else b"")


def unpacked(data: bytes) -> np.ndarray:
    n, kind = int.from_bytes(data[:8], "little"), np.dtype("<" + data[8:10].decode())
    if not n:
        return np.array([], kind)
    planes = np.frombuffer(_codec.decompress(data[10:], n * kind.itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).reshape(-1).view(kind)


def packed_keys(x: np.ndarray) -> bytes:
    """A sorted array of keys as its differences."""
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


class Block:
    """Tokenized documents: per document an id, whether held out and a size; tokens number the block's own words."""

    def __init__(self):
        self.ids, self.held, self.sizes, self.parts, self.tokens = [], [], [], [], 0
        self.words: dict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__

    def add(self, key, held: bool, text: bytes) -> None:
        number = self.words.__getitem__
        found = list(map(number, text.lower().split()))
        found.append(number(END))
        self.ids.append(key)
        self.held.append(held)
        self.sizes.append(len(found))
        self.parts.append(np.array(found, np.int32))
        self.tokens += len(found)

    def row(self, block: int) -> pa.RecordBatch:
        tokens = np.concatenate(self.parts)
        training = np.repeat(~np.array(self.held, bool), self.sizes)
        counts = np.bincount(tokens[training], minlength=len(self.words)).astype(np.int32)
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        columns = [
            pa.array([block], pa.int64()), pa.array([self.ids], pa.list_(pa.int64())), pa.array([self.held], pa.list_(pa.bool_())),
            pa.array([self.sizes], pa.list_(pa.int32())), *(pa.array([packed(x)], pa.binary()) for x in (tokens, hashes, counts)),
            pa.array([int(training.sum())], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=BLOCK_COLUMNS)


BLOCK_SCHEMA = "block long, ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary, counts binary, training long"
BLOCK_COLUMNS = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]


def blocks_of(docs: DataFrame, id_col: str, text: str, held: Column, block_tokens: int) -> DataFrame:
    def run(batches):
        first, made, block = TaskContext.get().partitionId() << 32, 0, Block()
        for batch in batches:
            for part in steps(batch, "text"):
                for key, out, t in zip(part.column("id").to_pylist(), part.column("held").to_pylist(), utf8(part, "text"), strict=True):
                    block.add(key, out, t)
                    if block.tokens >= block_tokens:
                        yield block.row(first + made)
                        made, block = made + 1, Block()
        if block.tokens:
            yield block.row(first + made)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text).alias("text"))
    return rows.mapInArrow(run, BLOCK_SCHEMA)


def bucketed(rows: DataFrame, key: str, buckets: int) -> tuple[DataFrame, Callable[[], None]]:
    """``rows`` as a table in the shared folder bucketed by ``key``, and what removes it. Joins by the key leave its rows where they are."""
    spark, name = rows.sparkSession, f"suffix_blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"

    def remove() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)

    try:
        rows.write.bucketBy(buckets, key).saveAsTable(name, format="parquet", compression="zstd", path=path)
    except BaseException:
        remove()
        raise
    return spark.table(name), remove


def each(batch: pa.RecordBatch, columns) -> Iterator[list]:
    """The rows of a batch one by one: a block is large."""
    for i in range(batch.num_rows):
        yield [batch.column(c)[i].as_py() for c in columns]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their total counts, and where each given key is among them."""
    found, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return found, total, where


def word_counts(blocks: DataFrame, buckets: int, least: int) -> DataFrame:
    """(block, bucket, reply, words, frequent, totals): each block's words' corpus counts, bucket by bucket.

    ``words`` (distinct training words) and the words of at least ``least`` come once for each bucket.
    """

    def ask(batches):
        for batch in batches:
            for block, words, counts in each(batch, ("block", "words", "counts")):
                words, counts = unpacked(words), unpacked(counts)
                of = bucket_of(words, buckets)
                order = np.argsort(of, kind="stable")
                bounds = np.searchsorted(of[order], np.arange(buckets + 1))
                some = [(b, order[i:j]) for b, (i, j) in enumerate(pairwise(bounds)) if j > i]
                columns = [
                    pa.array([b for b, _ in some], pa.int32()), pa.array([block] * len(some), pa.int64()),
                    pa.array([words[o].tobytes() for _, o in some], pa.binary()), pa.array([packed(counts[o]) for _, o in some], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "words", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        words = [np.frombuffer(x, np.uint64) for x in asked["words"].to_pylist()]
        found, total, where = summed(words, [unpacked(x) for x in asked["counts"].to_pylist()])
        ends = np.cumsum([len(w) for w in words])
        replies = [packed(total[x]) for x in np.split(where, ends[:-1])]
        often = total >= least
        once = lambda value, empty: [value] + [empty] * (len(words) - 1)
        return pa.table({
            "block": asked["block"], "bucket": asked["bucket"], "reply": pa.array(replies, pa.binary()),
            "words": pa.array(once(int((total > 0).sum()), 0), pa.int64()),
            "frequent": pa.array(once(found[often].view(np.int64), []), pa.list_(pa.int64())),
            "totals": pa.array(once(total[often], []), pa.list_(pa.int64())),
        })

    asked = blocks.select("block", "words", "counts").mapInArrow(ask, "bucket int, block long, words binary, counts binary")
    asked = asked.repartition(buckets, "bucket")
    schema = "block long, bucket int, reply binary, words long, frequent array<long>, totals array<long>"
    return cut(asked.groupBy("bucket").applyInArrow(answer, schema))


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is in sorted ``keys``, -1 if nowhere."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def sequences(words: np.ndarray, length: int) -> list[np.ndarray]:
    """For each number of words up to ``length`` the key of the sequence that ends at each token (of one word: the word's)."""
    out = [words]
    for _ in range(length - 1):
        x = np.empty_like(words)
        x[:1] = 0
        x[1:] = out[-1][:-1]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += words
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        out.append(x ^ (x >> np.uint64(31)))
    return out


def candidates(lengths: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Places where a sequence of ``length`` words can be frequent: both parts of it are."""
    part = lengths >= length - 1
    part[1:] &= part[:-1].copy()
    return np.flatnonzero(part & ~first)


def ranges(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) for each bucket that sorted ``keys`` have; buckets are ranges of keys, as in ``range_of``."""
    of = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    bounds = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    return [(b, int(i), int(j)) for b, (i, j) in enumerate(pairwise(bounds)) if j > i]


def range_of(key: Column, buckets: int) -> Column:
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * F.lit(buckets).cast("long"), 32).cast("int")


def _starts(sizes) -> np.ndarray:
    first = np.zeros(int(np.sum(sizes)), bool)
    first[np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)] = True
    return first


def _joined(replied, column: str, kind: type) -> np.ndarray:
    """One column of a block's replies, in the order of its sorted keys."""
    parts = [unpacked(x[column]) for x in sorted(replied or [], key=lambda x: x["bucket"])]
    return np.concatenate(parts) if parts else np.array([], kind)


def longer(blocks: DataFrame, state: DataFrame, length: int, least: int, buckets: int) -> DataFrame:
    """Rows (block, lengths) with the places of frequent sequences of ``length`` words, and rows of these themselves, each
    told by one block: key, context (the key without the last word), suffix (without the first) and n.
    """

    def ask(batches):
        for batch in batches:
            for block, sizes, held, *data in each(batch, SEQUENCE_COLUMNS):
                tokens, words, lengths = map(unpacked, data)
                places = candidates(lengths, _starts(sizes), length)
                keys, where = np.unique(sequences(words[tokens], length)[-1][places], return_inverse=True)
                training = np.repeat(~np.array(held, bool), sizes)[places]
                counts = np.bincount(where[training], minlength=len(keys)).astype(np.int32)
                some = ranges(keys, buckets)
                columns = [
                    pa.array([b for b, *_ in some], pa.int32()), pa.array([block] * len(some), pa.int64()),
                    *(pa.array([f(x[i:j]) for _, i, j in some], pa.binary()) for f, x in ((packed_keys, keys), (packed, counts))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "keys", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        """For each key of a block 0, 1 (frequent) or 2 (frequent, and the block is the one to tell), and the latter's counts."""
        asked = asked.sort_by("block")
        keys = [unpacked_keys(x) for x in asked["keys"].to_pylist()]
        found, total, where = summed(keys, [unpacked(x) for x in asked["counts"].to_pylist()])
        first = np.full(len(found), len(where))
        np.minimum.at(first, where, np.arange(len(where)))
        flags = (total >= least).astype(np.uint8)[where]
        flags[first[total >= least]] = 2
        ends = np.cumsum([len(x) for x in keys])[:-1]
        parts = [packed(x) for x in np.split(flags, ends)]
        counts = [packed(total[x[f == 2]]) for x, f in zip(np.split(where, ends), np.split(flags, ends), strict=True)]
        return pa.table({"block": asked["block"], "bucket": asked["bucket"], "flags": pa.array(parts, pa.binary()), "n": pa.array(counts, pa.binary())})

    def tell(batches):
        for batch in batches:
            for block, sizes, _, *data, replied in each(batch, [*SEQUENCE_COLUMNS, "replies"]):
                tokens, words, lengths = map(unpacked, data)
                places = candidates(lengths, _starts(sizes), length)
                *_, parts, whole = sequences(words[tokens], length)
                keys, at, where = np.unique(whole[places], return_index=True, return_inverse=True)
                flags, n = _joined(replied, "flags", np.uint8), _joined(replied, "n", np.int64)
                lengths = lengths.copy()
                lengths[places[flags[where] > 0]] = length
                own = places[at[flags == 2]]
                told = [keys[flags == 2].view(np.int64), parts[own - 1].view(np.int64), parts[own].view(np.int64), n]
                none = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed(lengths)], pa.binary()), *[none] * 4], schema=LONGER_ARROW)
                for a in range(0, len(own), TOLD_ROWS):
                    part = [pa.array(x[a : a + TOLD_ROWS], pa.int64()) for x in told]
                    size = len(part[0])
                    yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), *part], schema=LONGER_ARROW)

    known = blocks.join(state, "block").select(*SEQUENCE_COLUMNS)
    asked = known.mapInArrow(ask, "bucket int, block long, keys binary, counts binary")
    schema = "block long, bucket int, flags binary, n binary"
    replies = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, schema)
    gathered = replies.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "flags", "n")).alias("replies"))
    return cut(known.join(gathered, "block", "left").mapInArrow(tell, f"block long, lengths binary, {TOLD_SCHEMA}"))


def decide(found: DataFrame, level: DataFrame, before: DataFrame | None) -> DataFrame:
    """``found`` (frequent sequences) with log_p, log10 of the last word's probability after the others, and log_rest of these if retained.

    ``level`` has the same for the sequences of one word less, ``before`` the retained among their own contexts (key,
    log_rest; None if these have no word), which a retained context's suffix must be in.
    """
    contexts = level.select(F.col("key").alias("context"), F.col("n").alias("of"), F.col("suffix").alias("inner"))
    rows = found.join(level.select(F.col("key").alias("suffix"), F.col("log_p").alias("shorter")), "suffix").join(contexts, "context")
    p, q, less = F.col("n") / F.col("of"), F.pow(F.lit(10.0), "shorter"), (F.col("n") - DISCOUNT) / F.col("of")
    sums = rows.groupBy("context").agg(
        F.max("of").alias("all"), F.max("inner").alias("inner"), F.sum(p * F.log(p / q)).alias("apart"),
        (1 - F.sum(p)).alias("rest_p"), F.greatest(1 - F.sum(q), F.lit(1e-12)).alias("rest_q"),
        F.greatest(1 - F.sum(less), F.lit(1e-12)).alias("rest"),
    )
    apart = F.col("apart") + F.when(F.col("rest_p") > 0, F.col("rest_p") * F.log(F.col("rest_p") / F.col("rest_q"))).otherwise(0.0)
    states = sums.where((apart >= DIVERGENCE) & (2 * F.col("all") * apart >= SIGNIFICANT))
    if before is not None:
        states = states.join(before.select(F.col("key").alias("inner")), "inner", "left_semi")
    states = states.select("context", F.log10(F.col("rest") / F.col("rest_q")).alias("log_rest"))
    log_p = F.when(F.col("log_rest").isNotNull(), F.log10(less)).otherwise(F.col("shorter")).alias("log_p")
    return cut(rows.join(states, "context", "left").select("key", "context", "suffix", "n", "of", log_p, "log_rest"))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to: its cleaner waits for the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting takes a tenth of what the hash table behind ``np.unique`` does."""
    keys = np.sort(keys)
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


def frequent_keys(tokens: np.ndarray, words: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """The distinct keys of a block's frequent sequences of up to ``length`` words, in order."""
    often = np.zeros(len(words), bool)
    often[tokens[lengths > 0]] = True
    found = [words[often]]
    for i, x in enumerate(sequences(words[tokens], length)[1:], 1):
        found.append(distinct(x[lengths > i]))
    return distinct(np.concatenate(found))


def document_slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of documents of about ``most`` tokens."""
    ends, at = np.concatenate(([0], np.cumsum(sizes))), 0
    while at < len(sizes):
        to = min(max(int(np.searchsorted(ends, ends[at] + most)), at + 1), len(sizes))
        yield at, to
        at = to


def gains(ends: list[np.ndarray], lengths: np.ndarray, first: np.ndarray, keys: np.ndarray, log_p: np.ndarray, log_rest: np.ndarray) -> np.ndarray:
    """log10 of each token's probability in its state over that of the base; the values of sorted ``keys`` are nan where they have none."""
    gain, base = np.zeros(len(lengths)), np.zeros(len(lengths))
    at = np.full(len(lengths), -1)  # where the sequences of one word less are among the keys
    for depth, x in enumerate(ends):
        last, at = at, np.full(len(lengths), -1)
        some = np.flatnonzero(lengths > depth)
        at[some] = find(keys, x[some])
        if not depth:
            base[some] = log_p[at[some]]
            continue
        places = np.flatnonzero(~first & np.concatenate(([False], lengths[:-1] >= depth)))
        rest = log_rest[last[places - 1]]
        places, rest = places[~np.isnan(rest)], rest[~np.isnan(rest)]
        hit = lengths[places] > depth
        gain[places[~hit]] += rest[~hit]
        places = places[hit]
        gain[places] = log_p[at[places]] - base[places]
    return gain


def score(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text: str = "text", depth: int = DEPTH,
    least: int = LEAST, block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; learns from those not held out."""
    buckets = max(8, 2 * docs.select(text).rdd.getNumPartitions())
    blocks, remove = bucketed(blocks_of(docs, id_col, text, held_out, block_tokens), "block", buckets)
    try:
        return scored(blocks, buckets, depth, least).withColumnRenamed("id", id_col)
    finally:
        remove()


def scored(blocks: DataFrame, buckets: int, depth: int, least: int) -> DataFrame:
    """(id, held_out...) for each document of ``blocks``, written to the shared folder."""
    tokens = blocks.agg(F.coalesce(F.sum("training"), F.lit(0))).first()[0]
    replies = word_counts(blocks, buckets, least)
    distinct_words = replies.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    often = replies.where(F.size("frequent") > 0).select(F.inline(F.arrays_zip("frequent", "totals"))).toDF("key", "n")
    log_p = F.log10(F.col("n") + 1) - float(np.log10(tokens + distinct_words + 1))
    level, states = often.select("key", "n", log_p.alias("log_p"), F.lit(None).cast("long").alias("suffix")), None

    def look_up(batches):
        """Whether each token's word is frequent, and the base model's results for each document."""
        for batch in batches:
            for block, sizes, data, hashes, replied in each(batch, batch.schema.names):
                data, hashes = unpacked(data), unpacked(hashes)
                order = np.argsort(bucket_of(hashes, buckets), kind="stable")
                counts = np.empty(len(hashes), np.int64)
                counts[order] = np.concatenate([unpacked(x["reply"]) for x in sorted(replied, key=lambda x: x["bucket"])])
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
                base = np.add.reduceat(np.log10(counts + 1.0)[data], starts) - np.array(sizes) * np.log10(tokens + distinct_words + 1.0)
                known = np.add.reduceat((counts > 0)[data], starts, dtype=np.int64)
                columns = [
                    pa.array([block], pa.int64()), pa.array([packed((counts >= least).astype(np.uint8)[data])], pa.binary()),
                    pa.array([base], pa.list_(pa.float64())), pa.array([known], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "lengths", "base", "known"])

    gathered = replies.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))
    joined = blocks.select("block", "sizes", "tokens", "words").join(gathered, "block")
    first = cut(joined.mapInArrow(look_up, "block long, lengths binary, base array<double>, known array<long>"))
    state = first.select("block", "lengths")
    none = F.lit(None).cast("double")
    # probabilities are told as two small counts, which compress: n of a sequence, and n of its context (none for words)
    values = level.select("key", "n", F.lit(0).cast("long").alias("of"), none.alias("log_rest"))
    for length in range(2, depth + 2):
        told = longer(blocks, state, length, least, buckets)
        state = cut(told.where(F.col("block").isNotNull()).select("block", "lengths"))
        level = decide(told.where(F.col("block").isNull()).select(*TOLD_COLUMNS), level, states)
        del told
        # only what is retained stays; the frequent sequences themselves go with the next length
        own = cut(level.where(F.col("log_rest").isNotNull()).select("key", "context", "n", "of", "log_rest"))
        states = own.groupBy(F.col("context").alias("key")).agg(F.max("log_rest").alias("log_rest"))
        values = values.unionByName(own.select("key", "n", "of", none.alias("log_rest")))
        values = values.unionByName(states.select("key", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("of"), "log_rest"))
        release(blocks.sparkSession)
    del level
    release(blocks.sparkSession)

    def ask(batches):
        for batch in batches:
            for block, *data in each(batch, batch.schema.names):
                keys = frequent_keys(*map(unpacked, data), depth + 1)
                some = ranges(keys, buckets)
                columns = [
                    pa.array([b for b, *_ in some], pa.int32()), pa.array([block] * len(some), pa.int64()),
                    pa.array([packed_keys(keys[i:j]) for _, i, j in some], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "keys"])

    def answer(asked: pa.Table, values: pa.Table) -> pa.Table:
        wanted = [unpacked_keys(x) for x in asked["keys"].to_pylist()]
        columns = {}
        for names in (("n", "of"), ("log_rest",)):
            some = values.select(["key", *names]).drop_null()
            keys = some["key"].to_numpy().view(np.uint64)
            order = np.argsort(keys)
            at = [find(keys[order], x) for x in wanted]
            for c in names:
                found = some[c].to_numpy()[order]
                found = np.append(found, np.nan if c == "log_rest" else 0).astype(found.dtype)
                columns[c] = pa.array([packed(found[x]) for x in at], pa.binary())
        return pa.table({"block": asked["block"], "bucket": asked["bucket"]} | columns)

    def results(batches):
        for batch in batches:
            for _, ids, held, sizes, *data, base, n_known, replied in each(batch, batch.schema.names):
                data, sizes = [unpacked(x) for x in data], np.array(sizes, np.int64)
                keys = frequent_keys(*data, depth + 1)
                n, of = (_joined(replied, c, np.int64) for c in ("n", "of"))
                log_rest = np.append(_joined(replied, "log_rest", np.float64), np.nan)
                log_p = np.full(len(keys) + 1, np.nan)
                word, more = np.flatnonzero((n > 0) & (of == 0)), np.flatnonzero(of > 0)
                log_p[word] = np.log10(n[word] + 1.0) - np.log10(tokens + distinct_words + 1.0)
                log_p[more] = np.log10((n[more] - DISCOUNT) / of[more])
                del replied, n, of
                ends, score = np.concatenate(([0], np.cumsum(sizes))), np.array(base)
                for a, b in document_slices(sizes, SLICE_TOKENS):
                    here, starts = slice(ends[a], ends[b]), ends[a:b] - ends[a]
                    x = sequences(data[1][data[0][here]], depth + 1)
                    score[a:b] += np.add.reduceat(gains(x, data[2][here], _starts(sizes[a:b]), keys, log_p, log_rest), starts)
                columns = [
                    pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(n_known, pa.int64()),
                    pa.array([tokens] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(score),
                ]
                del data, keys, log_p, log_rest
                yield pa.RecordBatch.from_arrays(columns, names=RESULT_COLUMNS)

    table = values.withColumn("bucket", range_of(F.col("key"), buckets))
    asks, answers = "bucket int, block long, keys binary", "block long, bucket int, n binary, of binary, log_rest binary"
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = None
    for part in range(ROUNDS):
        held = blocks.join(state, "block").where(F.pmod("block", F.lit(ROUNDS)) == part)
        asked = held.select("block", "tokens", "words", "lengths").mapInArrow(ask, asks)
        replies = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(answer, answers)
        gathered = replies.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "of", "log_rest")).alias("replies"))
        whole = held.join(first.select("block", "base", "known"), "block").join(gathered, "block", "left")
        whole = whole.select("block", "ids", "held", "sizes", "tokens", "words", "lengths", "base", "known", "replies")
        scores = cut(whole.mapInArrow(results, schema))
        found = scores if found is None else found.unionByName(scores)
        del asked, replies, gathered, whole
        release(blocks.sparkSession)
    return found


SEQUENCE_COLUMNS = ["block", "sizes", "held", "tokens", "words", "lengths"]
TOLD_SCHEMA, TOLD_ROWS = "key long, context long, suffix long, n long", 1 << 16
TOLD_COLUMNS = [x.split()[0] for x in TOLD_SCHEMA.split(", ")]
LONGER_ARROW = pa.schema([("block", pa.int64()), ("lengths", pa.binary()), *((c, pa.int64()) for c in TOLD_COLUMNS)])
RESULT_COLUMNS = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
