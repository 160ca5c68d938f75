"""Exact top-k inner products by MaxScore over sharded postings (operator 7).

A vector's components are term weights, so each term has one posting (id, weight) for each row. Rows are dealt to shards
by a hash; a shard keeps its postings term by term with their largest and smallest weight. For a query, the product of
its own weight with these bounds is the most a term can add. Terms are taken in order of what they can change. The
threshold starts with the k-th score among rows at the head of the strongest postings. The essential terms are those
without which the rest together could still pass the threshold: their postings are traversed for all rows. The others
are only probed, in blocks, for rows whose score so far plus the rest's bounds still competes. Shards pass on their best
``k`` and the merge ranks those.

Postings are shuffled once, however many queries there are: a shard's postings come first in its partition, and its
queries follow in a stream. Only queries are copied, once for each shard, which an exact search of all rows needs.

Defined results: vectors that are null or hold null or non-finite components take no part; components beyond a vector's
length count as zero; an empty vector scores zero; ties go to the smaller id; null ids take no part; ids are integers; of
rows that repeat an id the one with the smallest vector (component by component) stands for the id; fewer candidates than
``k`` are all returned; a product or sum beyond 64 bits wraps around, so components need an absolute value below about
2**30 / 1024; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.ann import one_each, usable
from tidemark.llm.common import n_partitions

SHARD_ROWS, SHARD_LEAST, PROBE = 32_768, 2048, 8
SCALE = 1024


class Shard:
    """The postings of one shard: a row of weights for each term, over all its ids."""

    def __init__(self, ids: np.ndarray, postings: np.ndarray):
        self.ids = ids
        exact = postings.size == 0 or float(np.abs(postings).max()) < 1 << 20
        self.postings = np.ascontiguousarray(postings, np.float64 if exact else np.int64)  # whole numbers either way
        self.high, self.low = postings.max(axis=1, initial=0), postings.min(axis=1, initial=0)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k``."""
        small = self.postings.dtype == np.float64 and float(np.abs(query).max(initial=0)) < 1 << 20
        postings = self.postings if small else self.postings.astype(np.int64)
        query = query.astype(postings.dtype)
        terms = len(query)
        bounds = np.stack((query * self.high[:terms], query * self.low[:terms])).astype(postings.dtype)
        upper, lower = bounds.max(0), bounds.min(0)
        order = np.argsort(lower - upper, kind="stable")
        rest = np.append(np.cumsum(upper[order][::-1])[::-1], 0)  # the most that terms from here on add
        rows = np.flatnonzero(self.ids != own)
        if len(rows) > 4 * k and terms:
            heads = [rows[np.argpartition(-postings[t, rows] * query[t], k)[: k + 1]] for t in order[:4]]
            head = np.unique(np.concatenate(heads))
            floor = np.sort(query @ postings[:terms, head])[-k]
        else:
            floor = None
        # without its essential terms no row can pass the threshold
        essential = terms if floor is None else max(1, int(np.searchsorted(-rest[:-1], -floor, side="right")))
        step = order[:essential]
        scores = query[step] @ postings[np.ix_(step, rows)] if len(rows) else np.array([], postings.dtype)
        at = essential
        while True:
            if floor is not None:
                alive = scores + rest[at] >= floor
                rows, scores = rows[alive], scores[alive]
            if at >= terms or not len(rows):
                break
            step = order[at : at + PROBE]
            scores = scores + query[step] @ postings[np.ix_(step, rows)]
            at += len(step)
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best].astype(np.int64)


def _padded(columns: list[pa.Array], width: int) -> np.ndarray:
    out = np.zeros((sum(map(len, columns)), width), np.int64)
    at = 0
    for column in columns:
        sizes = np.diff(column.offsets.to_numpy())
        inside = np.arange(width) < sizes[:, None]
        out[at : at + len(column)][inside] = column.flatten().to_numpy()
        at += len(column)
    return out


def searches(batches, k: int):
    """Results of (shard, kind, vec_id, w) rows in order of shard and kind: postings of kind 0, then queries of kind 1."""
    now, postings, shard, width = None, [], None, 0
    for batch in batches:
        shards, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind"))
        edges = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            if end == start:
                continue
            part = batch.slice(start, end - start)
            if shards[start] != now:
                now, postings, shard = shards[start], [], None
            if kinds[start] == 0:
                postings.append(part)
                continue
            if not postings:
                continue
            if shard is None:
                width = max(int(np.diff(p.column("w").offsets.to_numpy()).max()) for p in postings)
                ids = np.concatenate([p.column("vec_id").to_numpy() for p in postings])
                shard = Shard(ids, _padded([p.column("w") for p in postings], width).T)
            most = max(width, int(np.diff(part.column("w").offsets.to_numpy()).max()))
            out: tuple[list, list, list] = ([], [], [])
            for own, query in zip(part.column("vec_id").to_pylist(), _padded([part.column("w")], most), strict=True):
                found, scores = shard.search(query[:width], own, k)  # what the postings lack counts as zero
                for o, values in zip(out, (np.full(len(found), own), found, scores), strict=True):
                    o.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], names=["query_id", "vec_id", "score"])


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of ``floor(1024 x)`` for each query row."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector).cast("array<double>"), zero=True)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * SCALE)).alias("w"),
    )
    rows = one_each(rows, "w")
    n, spark = rows.count(), vectors.sparkSession
    shards = max(1, -(-n // shard_rows), min(n_partitions(spark), n // SHARD_LEAST))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard")
    each = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    dealt = rows.select(own, F.lit(0).alias("kind"), "vec_id", "w")
    asked = rows.where("asks").select(each, F.lit(1).alias("kind"), "vec_id", "w")
    both = dealt.unionByName(asked).repartition(4 * shards, "shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(lambda batches: searches(batches, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE = """
with w as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 1024)::bigint) as w from embeddings),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::bigint as score
  from w q join w c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""
