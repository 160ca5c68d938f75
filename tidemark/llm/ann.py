"""Approximate nearest neighbours by inner product with balanced posting lists (operator 1).

Inner products become distances by one more component: with M the largest norm, a vector gets sqrt(M² - |v|²) and a
query 0, so that the nearest vector has the largest inner product. Both less M, so that one long vector doesn't take the
precision of all others. A query is scaled to the norm M, which leaves its order of vectors and makes its distances comparable to others'.

* Centroids come from k-means whose assignment charges a list for the rows it has beyond the average, so that lists are
  balanced. Up to ``FLAT`` lists are fitted on a sample of ``SAMPLE`` rows; beyond that the sample gives cells, and each
  cell's lists are fitted in a task of its own on the cell's part of a larger sample, so lists grow in number with the
  table, up to ``MOST_LISTS``. Every row is indexed.
* A vector goes to its nearest centroid's list and, where it lies near a boundary, to up to ``REPLICAS`` lists: those whose
  centroid is nearly as near and, in relation to the vector, far enough from those already chosen.
* A query walks a neighbour graph of the centroids in memory, from some lists spread over all, and selects the lists whose centroids lie within a ratio of
  the ``LISTS_LEAST``-th nearest one's distance (the nearest may be its own copies' centroid). The ratio is the smallest that finds the share ``recall`` of the neighbours of ``ASKED`` rows in a
  sample that the index wasn't fitted on, at the same radius as k neighbours have in the whole table; so vectors in groups need few lists and vectors
  without structure more. There are at least ``LISTS_LEAST`` lists, and as many as hold k candidates besides the query. Edges go both
  ways, since there are lists that are among the nearest of none. Many queries walk at once, all lists within their reach in one step.
* Lists are dealt to shards of about ``SHARD_ROWS`` rows, a list beyond ``LIST_MOST`` rows in parts. Postings are shuffled
  once; only a shard that more than ``QUERY_ROWS`` queries ask for is copied, once for each so many. A shard passes on each
  query's best ``k``, so nothing larger meets in the final ranking.

Defined results: vectors that are null, zero, of another length than the most common one (ties: the longer), or hold null
or non-finite components take no part; ties go to the smaller id; a query with fewer candidates gets them all; of rows that
repeat an id the one with the smallest vector (component by component) stands for the id; null ids take no part; ids are
integers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, n_partitions

SAMPLE, CELL_SAMPLE, PER_LIST = 20_000, 20_000, 16
LIST_ROWS, FLAT, MOST_LISTS, LIST_MOST = 16, 4096, 65_536, 2048
REPLICAS, NEAR, APART, DEGREE = 2, 1.2, 0.4, 24
RECALL, LISTS_LEAST, ASKED = 0.955, 4, 512
SHARD_ROWS, QUERY_ROWS = 16_384, 4096
CELLS_NEAR, CHUNK, WALKED, SPARE = 4, 2048, 1 << 20, 1


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to those of ``c``."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0)


def balanced(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centroids of ``lists`` balanced groups of the distinct rows of ``x``: a full list costs more than an empty one."""
    x = np.unique(x, axis=0)
    lists = max(1, min(lists, len(x)))
    c = x[np.random.default_rng(0).permutation(len(x))[:lists]].copy()
    fine = np.zeros(lists)
    for _ in range(rounds):
        of, cost = np.empty(len(x), np.int64), np.empty(len(x))
        for at in range(0, len(x), CHUNK):
            d = squared(x[at : at + CHUNK], c)
            of[at : at + CHUNK] = (d + fine).argmin(1)
            cost[at : at + CHUNK] = d.min(1)
        n = np.bincount(of, minlength=lists)
        fine = np.maximum(fine + 0.1 * cost.mean() * (n * lists / len(x) - 1), 0)
        sums = np.zeros(c.shape, np.float64)
        np.add.at(sums, of, x)
        c = (sums / np.maximum(n, 1)[:, None]).astype(np.float32)
        far = np.argsort(-cost, kind="stable")
        c[n == 0] = x[far[: int((n == 0).sum())]]
    return c


@dataclass
class Index:
    cells: np.ndarray  # float32, with the added component
    starts: np.ndarray  # where each cell's lists begin
    centroids: np.ndarray  # float32, cell by cell
    graph: np.ndarray  # the DEGREE nearest centroids of each, the next one and all that name it as such, one after another
    ends: np.ndarray  # where each centroid's neighbours begin and end in the graph
    gates: np.ndarray  # lists spread over all, where walks begin
    norm: float

    @staticmethod
    def of(cells: np.ndarray, parts: list[np.ndarray], norm: float) -> Index:
        starts = np.cumsum([0, *map(len, parts)])
        none = np.zeros((0, 0), np.int32)
        index = Index(cells, starts, np.concatenate(parts), none, none, none, norm)
        lists = len(index.centroids)
        centres = balanced(index.centroids, int(4 * np.sqrt(lists)), rounds=4)
        index.gates = np.unique(np.concatenate([squared(centres[i : i + CHUNK], index.centroids).argmin(1) for i in range(0, len(centres), CHUNK)]))
        degree = min(DEGREE, lists - 1)
        graph = np.empty((lists, degree), np.int32)
        for at in range(0, lists, CHUNK):
            # the nearest of all but itself, which comes first
            ids, d = index.nearest(index.centroids[at : at + CHUNK], degree + 1)
            own = ids == np.arange(at, at + len(ids))[:, None]
            own[~own.any(1), -1] = True
            graph[at : at + CHUNK] = ids[~own].reshape(len(ids), degree)
        ring = np.roll(np.arange(lists, dtype=np.int32), -1)[:, None]  # keeps the graph in one piece
        to = np.concatenate((graph, ring), axis=1)
        pair = np.repeat(np.arange(lists, dtype=np.int64), to.shape[1]) * lists + to.ravel()
        pair = np.unique(np.concatenate((pair, pair % lists * lists + pair // lists)))
        index.graph, index.ends = (pair % lists).astype(np.int32), np.searchsorted(pair, np.arange(lists + 1) * lists)
        return index

    def entries(self, vectors: np.ndarray) -> np.ndarray:
        """``vectors`` with the component that turns inner products into distances."""
        vectors = vectors.astype(np.float64)
        length = np.einsum("ij,ij->i", vectors, vectors)
        rest = -length / (np.sqrt(np.maximum(self.norm**2 - length, 0)) + self.norm)
        return np.concatenate((vectors, rest[:, None]), axis=1).astype(np.float32)

    def asked(self, queries: np.ndarray) -> np.ndarray:
        """``queries`` at the norm of the longest vector, with their added component."""
        queries = queries / np.abs(queries).max(1, keepdims=True)
        queries *= self.norm / np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
        return np.concatenate((queries, np.full((len(queries), 1), -self.norm)), axis=1)

    def nearest(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each entry the ``most`` nearest lists and their distances, looked for in the nearest cells."""
        ids, best = np.full((len(x), most), -1, np.int32), np.full((len(x), most), np.inf, np.float32)
        near = np.argsort(squared(x, self.cells), axis=1, kind="stable")[:, :CELLS_NEAR]
        if len(self.cells) > 1 and np.diff(self.starts)[near].sum(1).min() < most:
            near = np.broadcast_to(np.arange(len(self.cells)), (len(x), len(self.cells)))
        for cell in np.unique(near):
            rows = np.flatnonzero((near == cell).any(1))
            a, b = self.starts[cell], self.starts[cell + 1]
            d = np.concatenate((best[rows], squared(x[rows], self.centroids[a:b])), axis=1)
            all_ids = np.concatenate((ids[rows], np.broadcast_to(np.arange(a, b, dtype=np.int32), (len(rows), b - a))), axis=1)
            kept = np.argsort(d, axis=1, kind="stable")[:, :most] if most > d.shape[1] // 4 else None
            if kept is None:
                kept = np.argpartition(d, most - 1, axis=1)[:, :most]
                kept = np.take_along_axis(kept, np.argsort(np.take_along_axis(d, kept, 1), axis=1, kind="stable"), 1)
            best[rows], ids[rows] = np.take_along_axis(d, kept, 1), np.take_along_axis(all_ids, kept, 1)
        return ids, np.sqrt(best)

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: nearest list and boundary replicas."""
        most = min(REPLICAS, len(self.centroids))
        near, d = self.nearest(self.entries(vectors), most)
        chosen = d <= NEAR * d[:, :1]
        for i in range(1, most):
            for j in range(i):
                between = np.sqrt(((self.centroids[near[:, i]] - self.centroids[near[:, j]]) ** 2).sum(1))
                chosen[:, i] &= ~chosen[:, j] | (between > APART * d[:, i])
        rows, places = np.nonzero(chosen)
        return rows, near[rows, places]

    def select(self, queries: np.ndarray, ratio: float, counts: np.ndarray, least: int) -> list[np.ndarray]:
        """For each query the lists whose centroids are within ``ratio`` of the ``LISTS_LEAST``-th nearest one's distance, found along the graph.

        The nearest ``LISTS_LEAST`` come in any case, and as many as have ``least`` of the ids that ``counts`` has by list.
        """
        out, lists = [], len(self.centroids)
        c = self.centroids.astype(np.float64)
        half = np.einsum("ij,ij->i", c, c)
        step = max(1, WALKED // lists)
        for at in range(0, len(queries), step):
            q = self.asked(queries[at : at + step])
            own = np.einsum("ij,ij->i", q, q)
            d = np.full((len(q), lists), np.inf)
            open_ = np.zeros((len(q), lists), bool)
            d[:, self.gates] = np.maximum(own[:, None] + half[self.gates] - 2 * (q @ c[self.gates].T), 0)
            open_[:, self.gates] = True
            kth, going, spare = min(LISTS_LEAST, lists) - 1, np.arange(len(q)), np.zeros(len(q), np.int64)
            while len(going):
                near, free = d[going], open_[going]
                reach = np.partition(near, kth, axis=1)[:, kth] * ratio**2
                wanted = free & (near <= reach[:, None])
                # nothing in reach is left: walk on a little, another basin may be behind, and further if too few rows are found
                dry = ~wanted.any(1)
                spare[going[dry]] += 1
                dry &= free.any(1) & ((spare[going] <= SPARE) | (np.where(np.isfinite(near) & ~free, counts, 0).sum(1) < least))
                if dry.any():
                    rows = np.flatnonzero(dry)
                    outside = np.where(free[rows], near[rows], np.inf)
                    most = min(DEGREE, lists) - 1
                    wanted[rows] = free[rows] & (outside <= np.partition(outside, most, axis=1)[:, most, None])
                rows, nodes = np.nonzero(wanted)
                open_[going[rows], nodes] = False
                size = self.ends[nodes + 1] - self.ends[nodes]
                to = self.graph[np.repeat(self.ends[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                fresh = np.zeros((len(going), lists), bool)
                fresh[np.repeat(rows, size), to] = True
                rows, nodes = np.nonzero(fresh & ~np.isfinite(near))
                for i in range(0, len(rows), WALKED // 16):
                    r, o = going[rows[i : i + WALKED // 16]], nodes[i : i + WALKED // 16]
                    d[r, o] = np.maximum(own[r] + half[o] - 2 * np.einsum("ij,ij->i", q[r], c[o]), 0)
                    open_[r, o] = True
                going = going[wanted.any(1)]
            reach = np.partition(d, kth, axis=1)[:, kth] * ratio**2
            for near, far in zip(d, reach, strict=True):
                found = np.flatnonzero(np.isfinite(near))
                found = found[np.argsort(near[found], kind="stable")]
                before = np.cumsum(counts[found]) - counts[found]
                out.append(found[(near[found] <= far) | (np.arange(len(found)) < LISTS_LEAST) | (before < least)].astype(np.int32))
        return out


def calibrated(index: Index, sample: np.ndarray, near: int, recall: float) -> float:
    """The ratio at which the share ``recall`` of the ``near`` nearest rows of the sample lie in a selected list."""
    x = np.unique(sample, axis=0)
    asked = x[np.random.default_rng(1).permutation(len(x))[:ASKED]]
    parts = [(index.assign(x[at : at + CHUNK]), at) for at in range(0, len(x), CHUNK)]
    rows, lists = np.concatenate([p[0] + at for p, at in parts]), np.concatenate([p[1] for p, _ in parts])
    needed = []
    for q in asked:
        scores = x @ q
        scores[(x == q).all(1)] = -np.inf
        top = np.argsort(-scores, kind="stable")[: min(near, len(x) - 1)]
        d = np.sqrt(squared(index.asked(q[None]), index.centroids.astype(np.float64)))[0]
        each = np.full(len(x), np.inf)
        np.minimum.at(each, rows, d[lists])
        needed.append(each[top] / max(float(np.sort(d)[: LISTS_LEAST][-1]), 1e-12))
    found = np.concatenate(needed) if needed else np.array([])
    return float(np.quantile(found, recall)) if len(found) else 1.0


def usable(vector: Column, zero: bool = False) -> Column:
    """Whether a vector has only finite components (and, unless ``zero``, one that isn't zero)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = vector.isNotNull() & F.forall(vector, finite)
    return F.coalesce(good if zero else good & F.exists(vector, lambda x: x != 0), F.lit(False))


def one_each(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` (vec_id, asks, ``vector``) with one row for each id, that of the smallest vector.

    Only ids are shuffled to see whether any repeats; if so, vectors are, and a repeated one meets only its partial minima.
    """
    repeated = rows.groupBy("vec_id").count().where(F.col("count") > 1)
    if repeated.isEmpty():
        return rows
    best = rows.groupBy("vec_id").agg(F.min(F.struct(vector, "asks")).alias("best"))
    return best.select("vec_id", "best.asks", f"best.{vector}")


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def top(scores: np.ndarray, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of rows that ``scores`` (any summation order, -inf: not scored) leaves in question, scored exactly."""
    asked = np.flatnonzero((scores > -np.inf) & (ids != own))
    kept, among = (k + 1) * REPLICAS, scores[asked]
    while True:  # a row may be in several lists
        rows = asked
        if kept < len(asked):
            least = np.partition(among, len(asked) - kept)[len(asked) - kept]
            rows = asked[among >= least - 1e-9 * abs(least)]
        if len(rows) == len(asked) or len(np.unique(ids[rows])) >= k:
            break
        kept *= 4
    exact = (vectors[rows] * query).sum(axis=1)
    order = np.lexsort((ids[rows], -exact))
    best = order[np.sort(np.unique(ids[rows][order], return_index=True)[1])[:k]]
    return ids[rows[best]], exact[best]


def build(rows: DataFrame, n: int, width: int, norm: float, list_rows: int) -> tuple[Index, np.ndarray]:
    """The index, and a sample that it wasn't fitted on (all rows, where there are few). ``rows`` has vec_id and v."""
    unit, place = 1 << 30, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30))
    drawn = rows.where(place < -(-unit * 2 * SAMPLE // n)).select("v", place.alias("place")).limit(4 * SAMPLE).toArrow()
    if not drawn.num_rows:
        drawn = rows.select("v", place.alias("place")).limit(SAMPLE).toArrow()
    fitted = drawn["place"].to_numpy() < -(-unit * SAMPLE // n)
    fitted = fitted if fitted.any() else ~fitted
    sample, rest = matrix(drawn["v"], width)[fitted], matrix(drawn["v"], width)[~fitted]
    rest = rest if len(rest) >= SAMPLE // 4 else np.concatenate((sample, rest))
    lists = max(1, min(MOST_LISTS, -(-n // list_rows)))
    empty = Index(*[np.zeros((0, 0), np.float32)] * 6, norm)
    entries = empty.entries(sample)
    if lists <= FLAT:
        found = balanced(entries, lists)
        return Index.of(found.mean(0, keepdims=True), [found], norm), rest
    cells = balanced(entries, int(np.sqrt(lists)))
    shared = rows.sparkSession.sparkContext.broadcast(Index(cells, np.arange(len(cells) + 1), cells, empty.graph, empty.ends, empty.gates, norm))

    def place_in(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                of = squared(shared.value.entries(matrix(part.column("v"), width)), shared.value.cells).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), *part.select(["v", "place"]).columns], names=["cell", "v", "place"])

    def fit_lists(cell: pa.Table) -> pa.Table:
        x = shared.value.entries(matrix(cell["v"], width))
        found = balanced(x, max(1, round(len(x) / PER_LIST)))
        return pa.table({"cell": pa.array([cell["cell"][0].as_py()] * len(found), pa.int32()), "c": pa.array(list(found), pa.list_(pa.float32()))})

    wide = rows.where(place < -(-unit * lists * PER_LIST // n)).select("v", place.alias("place"))
    kind = dict(rows.dtypes)["v"]
    placed = wide.mapInArrow(place_in, f"cell int, v {kind}, place long")
    few = F.row_number().over(Window.partitionBy("cell").orderBy("place")) <= CELL_SAMPLE  # bounds the task of a crowded cell
    placed = placed.withColumn("few", few).where("few").select("cell", "v")
    # at most about MOST_LISTS centroids
    made = placed.groupBy("cell").applyInArrow(fit_lists, "cell int, c array<float>").toArrow()
    of, c = made["cell"].to_numpy(), made["c"].combine_chunks().flatten().to_numpy().reshape(-1, width + 1)
    parts = [c[of == i] if (of == i).any() else cells[i : i + 1] for i in range(len(cells))]
    return Index.of(cells, parts, norm), rest


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
    recall: float = RECALL, list_rows: int = LIST_ROWS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` names, its ``k`` largest inner products found."""
    return probed(vectors, is_query, k, id_col, vector, recall, list_rows, shard_rows, query_rows)[0]


def probed(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding",
    recall: float = RECALL, list_rows: int = LIST_ROWS, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> tuple[DataFrame, dict[str, float]]:
    """What ``search`` returns, and figures: lists, copies of a vector, share of the lists that a query probes, ratio."""
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType == T.ArrayType(T.FloatType(), True) or vectors.schema[vector].dataType == T.ArrayType(T.FloatType(), False)
    kind = "array<float>" if single else "array<double>"
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector).cast("array<double>"))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).cast(kind).alias("v")
    )
    lengths = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    kinds = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"), F.sqrt(F.max(lengths)).alias("norm"), F.count_if("asks").alias("asking"))
    most = kinds.orderBy(F.desc("n"), F.desc("width")).first()
    schema = "query_id long, vec_id long, score double"
    if most is None:
        empty = spark.createDataFrame([], schema)
        return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score"), {"lists": 0, "copies": 0, "share": 0, "ratio": 1}
    width, n, norm = most["width"], most["n"], most["norm"]
    rows = one_each(rows.where(F.size("v") == width), "v")
    index, sample = build(rows.select("vec_id", "v"), n, width, norm, list_rows)
    ratio = calibrated(index, sample, max(1, round(k * len(sample) / n)), recall)
    lists = len(index.centroids)
    shared = spark.sparkContext.broadcast(index)  # at most about MOST_LISTS centroids and their edges

    def assigned(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                places, of = shared.value.assign(matrix(part.column("v"), width))
                yield part, places, of

    def place(batches):
        for part, places, of in assigned(batches):
            yield pa.RecordBatch.from_arrays([part.column("vec_id").take(pa.array(places)), pa.array(of.astype(np.int32))], names=["vec_id", "list"])

    # ids and lists alone; each id counts in one of its lists, so that lists hold at least as many ids as these counts add up to
    narrow = cut(rows.select("vec_id", "v").mapInArrow(place, "vec_id long, list int"))
    sizes, counts = np.zeros(lists, np.int64), np.zeros(lists, np.int64)
    for r in narrow.groupBy("list").count().toLocalIterator():
        sizes[r[0]] = r[1]
    for r in narrow.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").count().toLocalIterator():
        counts[r[0]] = r[1]
    parts = np.maximum(-(-sizes // LIST_MOST), 1)
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    units = np.repeat(sizes / parts, parts)
    # lists of one cell follow one another, so that a query's lists are in few shards
    shard_of = (np.cumsum(units) // shard_rows).astype(np.int32)
    plan = spark.sparkContext.broadcast((sizes, counts, parts, first, shard_of))  # some numbers for each list

    def probe(batches):
        sizes, counts, parts, first, shard_of = plan.value
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, found in enumerate(shared.value.select(matrix(batch.column("v"), width), ratio, counts, k + 1)):
                found = np.sort(found[sizes[found] > 0])
                unit = np.concatenate([np.arange(first[x], first[x] + parts[x]) for x in found]) if len(found) else np.array([], np.int64)
                named, at = np.repeat(found, parts[found]), shard_of[unit]
                for shard in np.unique(at):
                    for o, value in zip(out, (i, shard, np.unique(named[at == shard])), strict=True):
                        o.append(value)
            columns = batch.take(pa.array(out[0], pa.int64())).select(["vec_id", "v"]).columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32()))], names=["query_id", "q", "shard", "lists"])

    tasks = max(n_partitions(spark), -(-most["asking"] // query_rows))
    asked = rows.where("asks").select("vec_id", "v").repartition(tasks, "vec_id")
    probes = cut(asked.mapInArrow(probe, f"query_id long, q {kind}, shard int, lists array<int>"))
    blocks = np.ones(int(shard_of.max(initial=0)) + 1, np.int64)
    probes_made = 0
    for r in probes.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.size("lists")).alias("lists")).toLocalIterator():
        blocks[r["shard"]] = -(-r["n"] // query_rows)
        probes_made += r["lists"]
    crowded = spark.sparkContext.broadcast(blocks)  # one number for each shard

    def post(batches):
        sizes, counts, parts, first, shard_of = plan.value
        for part, places, of in assigned(batches):
            ids = part.column("vec_id").to_numpy(zero_copy_only=False)[places]
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            shard = shard_of[first[of] + mixed % parts[of]]
            times = crowded.value[shard]
            again = np.repeat(np.arange(len(of)), times)
            block = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            columns = part.take(pa.array(places[again])).select(["vec_id", "v"]).columns
            columns += [pa.array(x.astype(np.int32)) for x in (of[again], shard[again], block)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "list", "shard", "block"])

    posted = rows.select("vec_id", "v").mapInArrow(post, f"vec_id long, v {kind}, list int, shard int, block int")
    many = spark.createDataFrame([(int(s), int(b)) for s, b in enumerate(blocks) if b > 1] or [(-1, 1)], "s int, blocks int")
    probes = probes.join(F.broadcast(many), F.col("shard") == F.col("s"), "left")  # as many rows as crowded shards
    probes = probes.withColumn("block", F.pmod(F.xxhash64("query_id"), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")).drop("s", "blocks")

    def score(members: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if members.num_rows and queries.num_rows:
            members = members.sort_by("list")
            ids, of, v = members["vec_id"].to_numpy(), members["list"].to_numpy(), matrix(members["v"], width)
            names, starts = np.unique(of, return_index=True)
            ends, place = np.append(starts[1:], len(of)), {int(x): i for i, x in enumerate(names)}
            for at in range(0, queries.num_rows, 256):
                part = queries.slice(at, 256)
                q, own = matrix(part["q"], width), part["query_id"].to_numpy()
                scores = np.full((len(q), len(ids)), -np.inf)
                want: dict[int, list[int]] = {}
                for i, some in enumerate(part["lists"].to_pylist()):
                    for x in some:
                        if x in place:
                            want.setdefault(place[x], []).append(i)
                for x, who in want.items():
                    scores[who, starts[x] : ends[x]] = q[who] @ v[starts[x] : ends[x]].T
                for i in range(len(q)):
                    found, exact = top(scores[i], ids, v, q[i], own[i], k)
                    for o, values in zip(out, (np.full(len(found), own[i]), found, exact), strict=True):
                        o.append(values)
        joined = [np.concatenate(o) if o else np.array([]) for o in out]
        return pa.table({"query_id": pa.array(joined[0], pa.int64()), "vec_id": pa.array(joined[1], pa.int64()), "score": pa.array(joined[2], pa.float64())})

    found = posted.groupBy("shard", "block").cogroup(probes.groupBy("shard", "block")).applyInArrow(score, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    figures = {
        "lists": lists, "copies": float(sizes.sum()) / n, "ratio": ratio,
        "share": probes_made / max(1, most["asking"]) / max(1, int((sizes > 0).sum())),
    }
    return best.select("query_id", "rank", "vec_id", "score"), figures
