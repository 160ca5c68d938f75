"""Density clusters of vectors: a hierarchy of mutual reachability, of which the most stable clusters are taken.

Neighbours are found exactly, for copies of a vector once. Vectors are packed into blocks, one row each, and blocks of seekers meet blocks of all vectors in a Cartesian
product, which reads blocks again and again but writes them once; the triangle inequality rules out those too far away, by cells around pivots. The
spanning tree grows in Borůvka rounds: every component but the largest takes its lightest edge out, among the neighbours known or, where a
lighter one may exist, by another search of the blocks. Points are folded into leaf clusters in about as many rounds as a cluster has points at
least. Only the tree of those leaf clusters, at most ``MOST_LEAVES``, is walked on the driver; points stay in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.lineage import FEW, Written, dealt
from tidemark.functions.lineage import cut as checkpointed

#: Rows of a block, pivots at most, and rows of a block of seekers.
PART, PIVOTS, CHUNK = 4_096, 1_024, 4_096
#: Bytes of blocks that seekers meet in one task, and blocks of seekers that do so one after the other.
HELD, QUEUE = 64 << 20, 8
#: Rows that meet a block at once, and pairs whose distances are computed at once from their differences.
STRIP, PAIRS = 512, 16_384
#: Leaf clusters whose tree the driver walks.
MOST_LEAVES = 500_000
NEAREST = 1e-9  # smaller distances count as this much in densities
PLACES = 12  # decimals of distances
NOISE = -1
FIXED = 2**20  # sums of densities don't depend on order


class Cells:
    """Points dealt to the nearest of some pivots, and packed into blocks of a few cells or of a part of one."""

    def __init__(self, points: DataFrame, n: int, most: int, cut: Written):
        self.spark = points.sparkSession
        rows = points.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, math.ceil(n / PART))).select("vector").collect()  # at most PIVOTS
        self.pivots = pivots = np.array([r[0] for r in rows], np.float64)

        def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                v = np.stack(f["vector"]) if len(f) else np.zeros((0, pivots.shape[1]))
                cell = squares(v, pivots).argmin(axis=1).astype(np.int32)
                yield f.assign(cell=cell, gap=np.sqrt(((v - pivots[cell]) ** 2).sum(axis=1)))

        self.members = cut(points.mapInPandas(nearest, "id long, vector array<double>, cell int, gap double"))
        self.radius = np.full(len(pivots), -np.inf)
        for r in self.members.groupBy("cell").agg(F.max("gap").alias("radius")).collect():  # at most PIVOTS
            self.radius[r.cell] = r.radius * (1 + 1e-12)
        self.scale = float(2 * (np.sqrt(squares(pivots[:1], pivots).max()) + self.radius.max())) or 1.0  # no two are farther apart
        rows, self.count = self.placed(self.members.select("id", "vector", "cell"), PART)
        self.blocks, self.block = cut(self.packed(rows, most)), rows.select("id", "block")
        self.bytes = self.blocks.agg(F.sum(F.length("vectors") + 4 * F.length("ids")).alias("n")).first().n

    def placed(self, rows: DataFrame, size: int) -> tuple[DataFrame, int]:
        """``rows`` with their ``block`` of about ``size``, and the number of blocks."""
        blocks, held, deal = 0, size, []
        for cell, n in sorted((r.cell, r.n) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()):  # at most PIVOTS
            if held + n > size:
                parts = math.ceil(n / size)
                deal.append((cell, blocks, parts))
                blocks, held = blocks + parts, n if parts == 1 else size
            else:
                deal.append((cell, blocks - 1, 1))
                held += n
        deals = F.broadcast(self.spark.createDataFrame(deal, "cell int, first int, parts int"))
        block = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block")
        return rows.join(deals, "cell").select(*rows.columns, block), blocks

    def packed(self, rows: DataFrame, most: int = 0) -> DataFrame:
        """``rows`` (id, vector, cell, block, and of seekers core, comp, bound) as one row for each block: ids in order, the rest likewise, the
        cells that they are from and those that they may reach within their bounds. With ``most`` these are the distances of so many
        neighbours in the block."""
        pivots, radius, scale = self.pivots, self.radius, self.scale
        more = [c for c in ("core", "comp") if c in rows.columns]

        def pack(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("id")
            v, ids = np.stack(f["vector"]), f["id"].to_numpy()
            if most:
                home = Nearest(ids, v, np.full(len(ids), np.inf), scale, most)
                home.meet(ids, v, np.arange(len(ids)))
                home.shrink()
                bound = home.bound
            else:
                bound = f["bound"].to_numpy()
            reach = (beyond(v, pivots, radius) <= wider(bound)[:, None]).any(axis=0)
            short = v.astype(np.float32)
            held = {"vectors": short if (short == v).all() else v, "ids": ids, "bound": bound} | {c: f[c].to_numpy() for c in more}
            return pd.DataFrame([{"block": f["block"].iloc[0], "cells": np.unique(f["cell"]), "reach": np.nonzero(reach)[0]} | {c: x.tobytes() for c, x in held.items()}])

        fields = "block int, cells array<int>, reach array<int>" + "".join(f", {c} binary" for c in ["vectors", "ids", "bound", *more])
        return rows.repartition(dealt(self.spark), "block").groupBy("block").applyInPandas(pack, fields)

    def meet(self, seekers: DataFrame, lots: int, members: DataFrame, kernel: Callable[[pa.RecordBatch], Seekers], schema: str) -> DataFrame:
        """What is ``found`` for ``lots`` blocks of seekers, each of which ``kernel`` makes, after they met the blocks of ``members`` that they may reach."""
        tasks = max(4 * self.spark.sparkContext.defaultParallelism, math.ceil(lots / QUEUE))
        a = seekers.toDF(*(f"a_{c}" for c in seekers.columns)).repartition(min(lots, tasks))
        b = members.repartition(math.ceil(self.bytes / HELD))
        pivots, radius = self.pivots, self.radius

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, now = None, None
            for batch in batches:
                for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                    if row["a_block"][0].as_py() != at:
                        if now is not None:
                            yield now.found()
                        at, now = row["a_block"][0].as_py(), kernel(row)
                        gaps = beyond(now.v, pivots, radius)
                    ids = numbers(row, "ids", np.int64)
                    reached = gaps[:, row["cells"][0].values.to_numpy()] <= wider(now.bound)[:, None]
                    now.meet(ids, vectors(row, "vectors", len(ids), pivots.shape[1]), np.nonzero(reached.any(axis=1))[0], row)
            if now is not None:
                yield now.found()

        pairs = a.join(b.hint("shuffle_replicate_nl"), F.arrays_overlap("a_reach", "cells"))
        return pairs.drop("a_reach", "a_cells").mapInArrow(run, schema)


def numbers(row: pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[column][0].as_buffer(), kind)


def vectors(row: pa.RecordBatch, column: str, n: int, length: int) -> np.ndarray:
    """Packed vectors, in single precision where that has all of their digits."""
    short = row[column][0].as_buffer().size == 4 * n * length
    return numbers(row, column, np.float32 if short else np.float64).reshape(n, length).astype(np.float64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances of ``a`` and ``b``, less what rounding may have added."""
    error = (2 * a.shape[1] + 16) * 2.0**-53
    return np.maximum(((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)) * (1 - error) - 2 * (a @ b.T), 0)


def beyond(v: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How far the members of each cell are from ``v`` at least."""
    return np.sqrt(squares(v, pivots)) - radius


def wider(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + 1e-9) + 1e-11  # against rounding


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of the pairs of rows, to ``PLACES``."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        x = slice(at, at + PAIRS)
        out[x] = np.sqrt(((a[i[x]] - b[j[x]]) ** 2).sum(axis=1))
    return np.round(out, PLACES)


class Seekers:
    """A block of vectors that look for others within a bound each. Those farther away are told by products in single precision, less what
    rounding may have added; the distances of the rest are exact."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bound: np.ndarray, scale: float):
        self.ids, self.v, self.bound, self.scale, self.mean = ids, v, bound.copy(), scale, v.mean(axis=0)
        self.rest = 1 - (2 * v.shape[1] + 16) * 2.0**-24
        a = self.centred(v)
        self.left = np.concatenate([-2 * a, np.ones((len(a), 1), np.float32)], axis=1)
        self.own = self.rest * (a.astype(np.float64) ** 2).sum(axis=1)

    def centred(self, v: np.ndarray) -> np.ndarray:
        return ((v - self.mean) / self.scale).astype(np.float32)

    def near(self, v: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of ``rows`` and of ``v`` that may be within the rows' bounds, and few others; bounds may shrink on the way."""
        b, width = self.centred(v), -(-len(v) // 8) * 8
        right = np.zeros((b.shape[1] + 1, width), np.float32)
        right[:-1, : len(v)] = b.T
        right[-1, : len(v)] = self.rest * (b.astype(np.float64) ** 2).sum(axis=1)
        right[-1, len(v) :] = np.nan
        for at in range(0, len(rows), STRIP):
            i = rows[at : at + STRIP]
            with np.errstate(over="ignore"):
                limit = ((wider(self.bound[i]) / self.scale) ** 2 * (1 + 1e-6) - self.own[i] + 1e-37).astype(np.float32)
            within = (self.left[i] @ right <= limit[:, None]).ravel()
            eights = np.flatnonzero(within.view(np.uint64))  # few hold any
            some = np.flatnonzero(within.reshape(-1, 8)[eights])
            some = eights[some // 8] * 8 + some % 8
            yield i[some // width], some % width


class Nearest(Seekers):
    """Their ``most`` nearest others (id, other, d)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bound: np.ndarray, scale: float, most: int):
        super().__init__(ids, v, bound, scale)
        self.most, self.new, self.full = most, 0, np.zeros(len(ids), bool)
        self.held = [(np.array([], np.int64), np.array([], np.int64), np.array([]))]

    def meet(self, ids: np.ndarray, v: np.ndarray, rows: np.ndarray, row: pa.RecordBatch | None = None) -> None:
        rows = rows[~(self.full[rows] & (self.bound[rows] == 0))]
        some = v[: max(STRIP, 4 * self.most)]
        lost = rows[np.isinf(self.bound[rows])] if len(some) > self.most else rows[:0]
        for at in range(0, len(lost), STRIP):  # a first bound, by a few of the block
            i = lost[at : at + STRIP]
            place = np.argpartition(squares(self.v[i], some), self.most, axis=1)[:, : self.most + 1]  # it may be among them itself
            self.bound[i] = exact(self.v, some, np.repeat(i, self.most + 1), place.ravel()).reshape(place.shape).max(axis=1)
        for i, j in self.near(v, rows):
            other = ids[j] != self.ids[i]
            i, j = i[other], j[other]
            d = exact(self.v, v, i, j)
            closer = (d < self.bound[i]) | (d == self.bound[i]) & ~self.full[i]
            self.held.append((i[closer], ids[j[closer]], d[closer]))
            self.new += int(closer.sum())
            if self.new > self.most * len(self.ids):
                self.shrink()

    def shrink(self) -> None:
        i, other, d = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((other, d, i))
        i, other, d = i[order], other[order], d[order]
        start = np.searchsorted(i, np.arange(len(self.ids) + 1))
        self.full = np.diff(start) >= self.most
        self.bound[self.full] = d[start[:-1][self.full] + self.most - 1]
        keep = np.arange(len(i)) - start[i] < self.most
        self.held, self.new = [(i[keep], other[keep], d[keep])], 0

    def found(self) -> pa.RecordBatch:
        self.shrink()
        i, other, d = self.held[0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(other), pa.array(d)], names=["id", "other", "d"])


class Outside(Seekers):
    """The member of another component that is nearest to each by mutual reachability, if that is below its bound (a, b, w)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bound: np.ndarray, scale: float, core: np.ndarray, comp: np.ndarray):
        super().__init__(ids, v, bound, scale)
        self.core, self.comp, self.best = core, comp, np.full(len(ids), -1, np.int64)
        self.any = np.zeros(len(ids), bool)

    def meet(self, ids: np.ndarray, v: np.ndarray, rows: np.ndarray, row: pa.RecordBatch) -> None:
        core, comp = row["cores"][0].values.to_numpy(), row["comps"][0].values.to_numpy()
        if (comp == comp[0]).all():
            rows = rows[self.comp[rows] != comp[0]]
        lost = rows[np.isinf(self.bound[rows])]
        for at in range(0, len(lost), STRIP):  # a first bound
            i = lost[at : at + STRIP]
            w = np.maximum(np.sqrt(squares(self.v[i], v)), core)
            w[self.comp[i][:, None] == comp] = np.inf
            j = w.argmin(axis=1)
            some = np.isfinite(w[np.arange(len(i)), j])
            self.take(i[some], j[some], ids, v, core)
        for i, j in self.near(v, rows):
            out = (self.comp[i] != comp[j]) & (core[j] < self.bound[i])
            self.take(i[out], j[out], ids, v, core)

    def take(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, v: np.ndarray, core: np.ndarray) -> None:
        w = np.maximum(np.maximum(exact(self.v, v, i, j), core[j]), self.core[i])
        order = np.lexsort((ids[j], w, i))
        i, j, w = i[order], j[order], w[order]
        first = np.ones(len(i), bool)
        first[1:] = i[1:] != i[:-1]
        first &= w < self.bound[i]
        self.bound[i[first]], self.best[i[first]], self.any[i[first]] = w[first], ids[j[first]], True

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[self.any]) for x in (self.ids, self.best, self.bound)], names=["a", "b", "w"])


def neighbours(cells: Cells, most: int, cut: Written) -> DataFrame:
    """(id, other, d, place): the ``most`` nearest other points of each, ties to the smaller id among those found."""
    length, scale = cells.pivots.shape[1], cells.scale

    def kernel(row: pa.RecordBatch) -> Nearest:
        ids = numbers(row, "a_ids", np.int64)
        return Nearest(ids, vectors(row, "a_vectors", len(ids), length), numbers(row, "a_bound", np.float64), scale, most)

    found = cells.meet(cells.blocks, cells.count, cells.blocks.select("cells", "ids", "vectors"), kernel, "id long, other long, d double")
    order = Window.partitionBy("id").orderBy("d", "other")
    return cut(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most))


def outside(cells: Cells, seekers: DataFrame, comps: DataFrame, cut: Written) -> DataFrame:
    """(a, b, w): for each of ``seekers`` (id, core, comp, bound) the lightest edge to another component, if it is below the bound."""
    length, scale, n = cells.pivots.shape[1], cells.scale, seekers.count()

    def kernel(row: pa.RecordBatch) -> Outside:
        ids, (bound, core) = numbers(row, "a_ids", np.int64), (numbers(row, c, np.float64) for c in ("a_bound", "a_core"))
        return Outside(ids, vectors(row, "a_vectors", len(ids), length), bound, scale, core, numbers(row, "a_comp", np.int64))

    rows = cells.members.select("id", "vector", "cell").join(F.broadcast(seekers) if n <= FEW else seekers, "id")
    size = min(CHUNK, max(64, math.ceil(n / (2 * cells.spark.sparkContext.defaultParallelism))))
    rows, lots = cells.placed(rows, size)
    held = comps.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("id", "core", "comp"))).alias("x"))
    held = held.select("block", F.col("x.core").alias("cores"), F.col("x.comp").alias("comps"))
    members = cells.blocks.select("block", "cells", "ids", "vectors").join(held, "block").drop("block")
    return cut(cells.meet(cells.packed(rows), lots, members, kernel, "a long, b long, w double"))


def roots(targets: DataFrame, cut: Written) -> DataFrame:
    """(node, root): where chains of (node, target) end; a node that is its own target, or that is no node here, is an end."""
    now = cut(targets.select("node", F.col("target").alias("root")))
    while True:
        new = now
        for i in range(3):
            up = now.select(F.col("node").alias("_node"), F.col("root").alias(f"_{i}"))
            new = new.join(up, F.col("root") == F.col("_node"), "left").withColumn("root", F.coalesce(f"_{i}", "root")).drop("_node")
        new = cut(new.select("node", "root", (F.coalesce("_0", "root") != F.col("root")).alias("_moved")))  # more than one step was left
        moved = not new.where("_moved").isEmpty()
        now = new.drop("_moved")
        if not moved:
            return now


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def cores(cells: Cells, near: DataFrame, copies: DataFrame, least: int, most: int, cut: Written) -> DataFrame:
    """(id, core, floor, block): core distances, of so many ``copies`` (id, copies) each, and what edges that ``near`` doesn't list weigh at least."""
    order = Window.partitionBy("id").orderBy("d", "other")
    met = near.join(copies.toDF("other", "_n"), "other").join(copies, "id").withColumn("_n", F.col("copies") + F.sum("_n").over(order))
    marks = met.groupBy("id").agg(F.min(F.when(F.col("_n") >= least, F.col("d"))).alias("core"), F.max(F.when(F.col("place") == most, F.col("d"))).alias("d"))
    rows = cells.block.join(copies, "id").join(marks, "id", "left").withColumn("core", F.when(F.col("copies") >= least, 0.0).otherwise(F.col("core")))
    return cut(rows.select("id", "core", F.greatest("core", F.coalesce("d", F.lit(float("inf")))).alias("floor"), "block"))


def spanning_tree(cells: Cells, near: DataFrame, known: DataFrame, cut: Written) -> DataFrame | None:
    """(a, b, w): a minimum spanning tree by mutual reachability, None of a single point. ``known`` has the cores."""
    comps = known.select("id", F.col("id").alias("comp"), "core", "floor", "block")
    core = comps.select("id", "core")
    edges = near.join(core, "id").join(core.select(F.col("id").alias("other"), F.col("core").alias("core2")), "other")
    edges = edges.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.greatest("core", "core2", "d").alias("w")).distinct()
    edges = cut(both_ways(edges))
    tree = None
    while True:
        sizes = comps.groupBy("comp").agg(F.count("*").alias("n"))
        top = sizes.agg(F.count("*").alias("n"), F.max(F.struct("n", "comp")).alias("x")).first()
        if top.n == 1:
            return tree
        largest = top.x.comp

        def leaving(rows: DataFrame, comps: DataFrame = comps) -> DataFrame:
            rows = rows.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("u")), "a").join(comps.select(F.col("id").alias("b"), F.col("comp").alias("v")), "b")
            return rows.where(F.col("u") != F.col("v")).select("a", "b", "w", "u", "v")

        edges = cut(leaving(edges).select("a", "b", "w"))  # edges within components are done with
        bests = lambda rows: leaving(rows).where(F.col("u") != largest).groupBy("u").agg(F.min("w").alias("bound"))
        seeking = lambda rows, comps=comps: comps.where(F.col("comp") != largest).join(rows.withColumnRenamed("u", "comp"), "comp", "left")
        fields = ["id", "core", "comp", "bound"]
        bound = cut(bests(edges))
        # a component without any known edge out sends one point to all blocks first, for a bound
        lone = seeking(bound).where(F.col("bound").isNull()).groupBy("comp").agg(F.min_by(F.struct("id", "core"), "id").alias("x"))
        lone = cut(lone.select("x.*", "comp", F.lit(float("inf")).alias("bound")).select(*fields))
        if not lone.isEmpty():
            edges = edges.unionByName(both_ways(outside(cells, lone, comps, cut)))
            bound = cut(bests(edges))
        seekers = cut(seeking(bound).where(F.col("floor") < F.col("bound")).select(*fields))
        if not seekers.isEmpty():
            edges = edges.unionByName(both_ways(outside(cells, seekers, comps, cut)))
        edges = cut(edges.distinct())
        order = F.struct("w", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))  # strict, so choices make no cycles
        chosen = cut(leaving(edges).where(F.col("u") != largest).groupBy("u").agg(F.min(order).alias("e"), F.min_by("v", order).alias("v")))
        new = chosen.select(F.col("e.p").alias("a"), F.col("e.q").alias("b"), "e.w").distinct()
        tree = cut(new if tree is None else tree.unionByName(new))
        comps = merged(comps, chosen, cut)


def merged(comps: DataFrame, chosen: DataFrame, cut: Written) -> DataFrame:
    """``comps`` (id, comp, ...) after each of ``chosen`` (u, v, e) has joined the component that its edge leads to."""
    back = chosen.select(F.col("u").alias("_u"), F.col("v").alias("_v"))
    mutual = (F.col("_v") == F.col("u")) & (F.col("u") < F.col("v"))  # of two that choose each other the smaller is the end
    targets = chosen.join(back, F.col("v") == F.col("_u"), "left").select(F.col("u").alias("node"), F.when(mutual, F.col("u")).otherwise(F.col("v")).alias("target"))
    ends = roots(targets, cut).select(F.col("node").alias("comp"), "root")
    return cut(comps.join(ends, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"))


def fold(points: DataFrame, tree: DataFrame, least: int, cut: Written) -> tuple[DataFrame, DataFrame]:
    """(leaves, edges): of each point its leaf cluster and the level at which it leaves (id, leaf, w), and the lightest edges between leaves.

    A component below ``least`` points follows its lightest edge. If these edges lead to a leaf cluster, it joins that at its own
    edge's level; two that choose the same edge become one, which is a leaf cluster at that level once it is large enough.
    """
    nodes = cut(points.select("id", F.col("id").alias("node"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("long").alias("leaf")))
    edges = cut(tree.select("a", "b", "w", F.col("a").alias("u"), F.col("b").alias("v")))
    while True:
        small = nodes.where("leaf is null").groupBy("node").agg(F.count("*").alias("n"))
        if small.isEmpty():
            break
        sides = edges.unionByName(edges.select("a", "b", "w", F.col("v").alias("u"), F.col("u").alias("v")))
        order = F.struct("w", "a", "b")
        first = cut(sides.join(small.select(F.col("node").alias("u")), "u", "left_semi").groupBy("u").agg(F.min(order).alias("e"), F.min_by("v", order).alias("v")))
        back = first.select(F.col("u").alias("_u"), F.col("e").alias("_e"))
        pairs = first.join(back, (F.col("v") == F.col("_u")) & (F.col("e") == F.col("_e"))).select("u", F.least("u", "v").alias("to"), "e.w")
        pairs = cut(pairs)
        pointing = first.join(pairs.select("u"), "u", "left_anti").select(F.col("u").alias("node"), F.col("v").alias("target"))
        ends = roots(pointing.unionByName(pairs.select(F.col("u").alias("node"), F.col("u").alias("target"))), cut)
        inside = ends.join(small.select(F.col("node").alias("root")), "root", "left_anti").join(first.select(F.col("u").alias("node"), "e.w"), "node")
        joins = inside.select("node", F.col("root").alias("to"), F.col("w").alias("_w"), F.col("root").alias("_leaf"))
        grown = pairs.join(small.select(F.col("node").alias("u"), "n"), "u")
        size = F.sum("n").over(Window.partitionBy("to"))  # two rows
        grown = grown.withColumn("_n", size).select(F.col("u").alias("node"), "to", *(F.when(F.col("_n") >= least, F.col(x)).alias(y) for x, y in (("w", "_w"), ("to", "_leaf"))))
        moves = cut(joins.unionByName(grown))
        found = nodes.where("leaf is not null")
        moved = nodes.where("leaf is null").join(moves, "node", "left").select("id", F.coalesce("to", "node").alias("node"), F.col("_w").alias("w"), F.col("_leaf").alias("leaf"))
        nodes = cut(found.unionByName(moved))
        for end in ("u", "v"):
            edges = edges.join(moves.select(F.col("node").alias(end), F.col("to").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        edges = cut(edges.where(F.col("u") != F.col("v")).select("a", "b", "w", "u", "v"))
    return nodes.select("id", "leaf", "w"), edges.select("u", "v", "w")


class LeafTree:
    """The tree of clusters above the leaf clusters (ids, in order, and levels). Equal levels are one: no cluster begins and ends at the same."""

    def __init__(self, leaves: np.ndarray, births: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray):
        self.leaves, n = leaves, len(leaves)
        low = np.concatenate([births, np.zeros(n)])  # the level at which a cluster falls apart
        parent, top = np.arange(2 * n, dtype=np.int32), np.full(2 * n, math.inf)
        group = np.arange(n)  # a union-find over leaves; at its roots the present cluster
        holds, count = np.arange(n), n

        def find(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return int(x)

        order = np.lexsort((v, u, w))
        u, v, w = np.searchsorted(leaves, u[order]), np.searchsorted(leaves, v[order]), w[order]
        at = 0
        while at < len(w):
            level, met = w[at], {}
            while at < len(w) and w[at] == level:
                x, y = find(u[at]), find(v[at])
                if x != y:
                    met[y] = met.pop(x, [int(holds[x])]) + met.pop(y, [int(holds[y])])
                    group[x] = y
                at += 1
            for end, clusters in met.items():
                real = [c for c in clusters if low[c] < level]
                if len(real) == 1:
                    to = real[0]
                else:
                    to, count = count, count + 1
                    low[to] = level
                for c in clusters:
                    if c != to:
                        parent[c], top[c] = to, level if low[c] < level else -math.inf
                holds[end] = to
        self.low, self.parent, self.top, self.root = low[:count], parent[:count], top[:count], int(holds[find(0)])

    def steps(self) -> np.ndarray:
        """Parents of 1, 2, 4, ... steps."""
        jumps = [self.parent]
        while (jumps[-1][jumps[-1]] != jumps[-1]).any():
            jumps.append(jumps[-1][jumps[-1]])
        return np.stack(jumps)

    def selected(self, own: np.ndarray, total: np.ndarray) -> np.ndarray:
        """For each cluster the selected one that it is in, or -1. ``own``, ``total``: count and sum of densities of the points that leave a cluster."""
        real = np.nonzero(self.top != -np.inf)[0]
        real = real[np.lexsort((real, self.low[real]))].tolist()  # children before parents
        within, below, chosen = (np.zeros(len(self.low), t) for t in (np.int64, np.float64, bool))
        for c in real:
            if c == self.root:
                continue
            size = own[c] + within[c]
            gain = total[c] + within[c] * density(self.low[c]) - size * density(self.top[c])
            if below[c] > gain:
                gain = below[c]
            else:
                chosen[c] = True
            up = self.parent[c]
            within[up] += size
            below[up] += gain
        out = np.full(len(self.low), -1, np.int32)
        for c in reversed(real):
            up = out[self.parent[c]] if c != self.root else -1
            out[c] = up if up >= 0 else (c if chosen[c] else -1)
        return out


def density(distance: float) -> float:
    return 1 / max(distance, NEAREST)


def density_clusters(rows: DataFrame, id_col: str, vector: str, least: int = 5) -> DataFrame:
    """(id, cluster): the density clusters of at least ``least`` vectors, numbered from 0 by their smallest id, -1 for noise.

    The core distance of a vector is that to its ``least`` - 1st nearest other one; two are as far apart as the largest of their distance and both core
    distances. Components of at least ``least`` vectors below a distance are clusters; one lasts until it falls apart into
    several. From the leaves on the more stable of a cluster and its parts is taken, never all vectors as one. Equal
    distances are one level. Ids are integers; rows without one don't count, and rows of the same id are one, of the smallest vector.
    Vectors that are null, hold null or non-finite components, or differ in length from most of them are noise.
    """
    cut = Written(rows.sparkSession)
    try:
        return checkpointed(labelled(rows, id_col, vector, max(2, least), cut))
    finally:
        cut.close(rows.sparkSession)


def labelled(rows: DataFrame, id_col: str, vector: str, least: int, cut: Written) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    given = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    given = cut(given.withColumn("vector", F.when(F.forall("vector", finite) & (F.size("vector") > 0), F.col("vector"))))
    length = given.where("vector is not null").groupBy(F.size("vector").alias("k")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "k")).alias("x")).first().x
    points = given.where(F.size("vector") == (length.k if length else 0))
    n = points.count()
    if n < least:
        return given.select("id", F.lit(NOISE).alias("cluster"))
    most = max(2 * least, 10)
    firsts = cut(points.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("copies")))  # copies are searched for once
    distinct = firsts.count()
    cells = Cells(firsts.select("id", "vector"), distinct, most, cut)
    near = neighbours(cells, most, cut)
    known = cores(cells, near, firsts.select("id", "copies"), least, most, cut)
    tree = spanning_tree(cells, near, known, cut)
    if distinct < n:  # no edge of a copy is lighter than that to the first one
        first = firsts.select("vector", F.col("id").alias("b")).join(known.select(F.col("id").alias("b"), F.col("core").alias("w")), "b")
        same = points.select(F.col("id").alias("a"), "vector").join(first, "vector").where(F.col("a") != F.col("b")).select("a", "b", "w")
        tree = cut(same if tree is None else tree.unionByName(same))
    leaves, edges = fold(points, tree, least, cut)
    births = leaves.groupBy("leaf").agg(F.min("w").alias("w")).limit(MOST_LEAVES + 1).toArrow().sort_by("leaf")
    if len(births) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaf clusters: ask for larger ones")
    joins = edges.toArrow()  # one less than leaves
    leaf_tree = LeafTree(*(x.to_numpy() for x in (*births.select(["leaf", "w"]).columns, *joins.select(["u", "v", "w"]).columns)))
    return given.join(assigned(leaves, leaf_tree, cut), "id", "left").select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))


def assigned(leaves: DataFrame, tree: LeafTree, cut: Written) -> DataFrame:
    """(id, cluster) of the points that are in a selected cluster."""
    jumps, top, low, keys = tree.steps(), tree.top, tree.low, tree.leaves

    def climb(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            now, w = np.searchsorted(keys, f["leaf"].to_numpy()), f["w"].to_numpy()
            now = np.where(top[now] == -np.inf, jumps[0][now], now)  # clusters of no duration are left at once
            for step in jumps[::-1]:  # levels grow upwards
                now = np.where(low[step[now]] <= w, step[now], now)
            yield pd.DataFrame({"id": f["id"], "node": now.astype(np.int64), "w": w})

    nodes = cut(leaves.mapInPandas(climb, "id long, node long, w double"))
    fixed = F.round(1 / F.greatest("w", F.lit(NEAREST)) * FIXED).cast("decimal(38,0)")
    left = nodes.groupBy("node").agg(F.count("*").alias("n"), (F.sum(fixed).cast("double") / FIXED).alias("s")).toArrow()  # one row a cluster
    own, total = np.zeros(len(low), np.int64), np.zeros(len(low))
    node = left["node"].to_numpy()
    own[node], total[node] = left["n"].to_numpy(), left["s"].to_numpy()
    chosen = tree.selected(own, total)

    def among(names: np.ndarray, rows: DataFrame) -> DataFrame:
        """``rows`` (id, node) of nodes that have names, with these."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                found = pd.DataFrame({"id": f["id"], "cluster": names[f["node"].to_numpy()]})
                yield found[found["cluster"] >= 0]

        return rows.select("id", "node").mapInPandas(run, "id long, cluster int")

    found = cut(among(chosen, nodes)).withColumnRenamed("cluster", "node")
    first = found.groupBy("node").agg(F.min("id").alias("id")).toArrow().sort_by("id")
    names = np.full(len(low), -1, np.int32)
    names[first["node"].to_numpy()] = np.arange(len(first))
    return among(names, found)
