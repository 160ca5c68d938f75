"""Near-duplicate documents by SimHash fingerprints and a segment-popcount embedding (operator 4).

A fingerprint bit is set if it is set in over half of the XXH64 hashes of a text's word shingles. To link fingerprints
that differ in at most ``distance`` bits, each is mapped to the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors never exceeds the Hamming distance, so a range join over a grid of count vectors loses no
link: the segments are dealt to ``groups`` groups, and of two vectors within the distance at least ``groups - distance``
groups are equal, so that the pair meets in the grid cell of one such choice of groups. In a cell, pairs beyond the
Manhattan distance go first, then the Hamming distance is verified exactly. Counts are kept in unary (0, 1, 11 for 0, 1
and 2 set bits), which makes Manhattan distance a bit count.

Equal fingerprints are joined before all this, cells of many fingerprints are split into blocks that meet two by two,
and a cell gives only edges that connect what is within reach, never all pairs. The number of groups follows the number
of distinct fingerprints, so that neither cells nor copies of a row become the larger cost.

64 bits cannot tell a similarity of 0.8 from chance at a radius that an exact grid reaches. ``similar`` therefore decides on
``LANES`` times 64 bits of five-word shingles: at a Jaccard similarity of 0.8 about 39 of 256 bits differ (deviation 6) and
``FAR`` may, of unrelated texts half do. Its grid has the segment popcounts of a second fingerprint, of word pairs, which edits of
single words change less; a cell is a random choice of segments, so many that it holds few unrelated fingerprints, and
there are so many choices that a pair of similarity 0.8 with edits spread over the text shares about ``SHARED`` cells.

Defined results: a text without words (null, empty, blank) has fingerprint zero and is linked like any other; a text of
fewer words than a shingle has one shingle, all its words; repeated rows share a component; a component without any
id has a null id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import map_steps, utf8
from tidemark.llm.common import cut, private
from tidemark.llm.graph import components

SEED = 42
SHINGLES_AT_ONCE = 1 << 17
EVEN = 0x5555555555555555
SEGMENTS = 32
BLOCK = 4096
SMALL_CELL = 256
#: One of so many nodes is counted to find crowded cells; so many crowded cells, of about 20 bytes each, may be broadcast.
SEEN, FEW = 16, 100_000
#: Bits that a two-bit segment's count tells apart among unrelated texts.
SEGMENT_BITS = 1.415
#: Of ``similar``: words of the deciding shingles and of the grid's, 64-bit lanes of each, differing bits that still link.
WORDS, LANES, FAR = 5, 4, 48
PAIR_WORDS, PAIR_LANES = 2, 2
#: The share of segments whose counts stay equal at a similarity of 0.8, how many cells such a pair should share, and how
#: many unrelated fingerprints a cell may hold.
STABLE, SHARED, UNRELATED = 0.82, 6.0, 32


def lanes_of(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """The bytes of ``lanes`` hashes for each hash: itself, and mixed again."""
    out, x = [hashes], hashes
    for _ in range(lanes - 1):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        y = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        y = (y ^ (y >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(y ^ (y >> np.uint64(31)))
    return np.ascontiguousarray(np.stack(out, axis=1).astype(">u8")).view(np.uint8)


def fingerprints_of(texts: list[bytes], words: int, lanes: int = 1) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit numbers: a row for each text, a column for each lane."""
    votes, total = np.zeros((len(texts), 64 * lanes), np.int64), np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owners: list[int] = []
    size, digest = 0, xxhash.xxh64_digest

    def count() -> None:
        nonlocal size
        if held:
            starts = np.concatenate(([0], np.cumsum([len(x) // 8 for x in held])[:-1]))
            hashes = np.frombuffer(b"".join(held), ">u8").astype(np.uint64)
            bits = np.unpackbits(lanes_of(hashes, lanes), axis=1)
            np.add.at(votes, owners, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
        held.clear()
        owners.clear()
        size = 0

    for k, text in enumerate(texts):
        split = text.lower().split()  # of bytes: only A-Z are lowered, and only ASCII white space separates
        if not split:
            continue
        joined = b" ".join(split)
        ends = list(accumulate(len(w) + 1 for w in split))
        starts = [0, *ends[:-1]]
        ends = ends[words - 1 :] or ends[-1:]
        total[k] = len(ends)
        for at in range(0, len(ends), SHINGLES_AT_ONCE // lanes):
            part = zip(starts[at : at + SHINGLES_AT_ONCE // lanes], ends[at : at + SHINGLES_AT_ONCE // lanes], strict=False)
            held.append(b"".join([digest(joined[i : j - 1], SEED) for i, j in part]))
            owners.append(k)
            size += len(held[-1]) // 8
            if size >= SHINGLES_AT_ONCE // lanes:
                count()
    count()
    return np.packbits(votes * 2 > total[:, None], axis=1).view(">i8").astype(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", words: int = 4, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, without the columns ``drop``, with ``simhash`` (long)."""
    run = lambda part: {"simhash": pa.array(fingerprints_of(utf8(part, text), words)[:, 0], pa.int64())}
    return map_steps(docs, text, [T.StructField("simhash", T.LongType())], run, drop)


PRINT, PAIRS = [f"print{i}" for i in range(LANES)], [f"pairs{i}" for i in range(PAIR_LANES)]


def sketches(docs: DataFrame, text: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs``, without ``drop``, with the lanes of both fingerprints that ``similar`` needs."""

    def run(part: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = utf8(part, text)
        found = np.concatenate((fingerprints_of(texts, WORDS, LANES), fingerprints_of(texts, PAIR_WORDS, PAIR_LANES)), axis=1)
        return {c: pa.array(found[:, i], pa.int64()) for i, c in enumerate(PRINT + PAIRS)}

    return map_steps(docs, text, [T.StructField(c, T.LongType()) for c in PRINT + PAIRS], run, drop)


def unary(x: np.ndarray) -> np.ndarray:
    """Of unsigned fingerprints: each two-bit segment's bit count as 00, 01 or 11."""
    low, high = x & np.uint64(EVEN), x >> np.uint64(1) & np.uint64(EVEN)
    return (low & high) << np.uint64(1) | low | high


def unary_column(x: Column) -> Column:
    """``unary`` as a column expression."""
    low, high = x.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(EVEN))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low).bitwiseOR(high)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least one that the edges connect it with."""
    root = np.arange(n)
    while len(left):
        least = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def cell_edges(prints: np.ndarray, cells: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect, within each cell, whatever chains of links connect: fewer than rows. ``cells`` is sorted.

    ``prints`` has a row of lanes for each fingerprint; the edges are places in it.
    """
    counts = unary(prints)
    near = lambda i, j: np.bitwise_count(counts[i] ^ counts[j]).sum(-1) <= distance
    exact = lambda i, j: np.bitwise_count(prints[i] ^ prints[j]).sum(-1) <= distance
    starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.array([], int)
    sizes = np.diff(np.r_[starts, len(cells)])
    left, right = [np.array([], int)], [np.array([], int)]
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL_CELL), sizes))
    last = np.repeat(starts + sizes, sizes)[small]
    for shift in range(1, SMALL_CELL):
        alive = small + shift < last
        small, last = small[alive], last[alive]
        if not len(small):
            break
        i = small[near(small, small + shift)]
        i = i[exact(i, i + shift)]
        left.append(i)
        right.append(i + shift)
    root = roots(len(prints), np.concatenate(left), np.concatenate(right))
    tied = np.flatnonzero(root != np.arange(len(prints)))
    left, right = [root[tied]], [tied]
    for start, size in zip(starts[sizes > SMALL_CELL], sizes[sizes > SMALL_CELL], strict=True):
        unseen = np.arange(start, start + size)
        while len(unseen):
            reached, unseen = [unseen[0]], unseen[1:]
            while reached and len(unseen):
                i = reached.pop()
                hit = near(i, unseen)
                hit[hit] = exact(i, unseen[hit])
                found, unseen = unseen[hit], unseen[~hit]
                left.append(np.full(len(found), i))
                right.append(found)
                reached += found.tolist()
    return np.concatenate(left), np.concatenate(right)


def meet(rows: DataFrame, node: str, lanes: list[str], distance: int, block: int) -> DataFrame:
    """(a, b): edges between nodes that meet in a ``cell`` (a column of ``rows``) and differ in at most ``distance`` bits."""
    rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    # a share of the nodes tells which cells to split; blocks needn't be of equal size
    some = rows.where(F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.lit(SEEN)) == 0) if block >= 64 * SEEN else rows
    counted = some.groupBy("cell").agg((F.count("*") * (SEEN if block >= 64 * SEEN else 1)).alias("count"))
    heavy = cut(counted.where(F.col("count") > block))
    crowded = heavy.limit(FEW + 1).count()
    if crowded:
        heavy = F.broadcast(heavy) if crowded <= FEW else heavy
        n = F.ceil(F.col("count") / F.lit(block)).alias("n")
        own = F.pmod(F.xxhash64(node), F.coalesce("n", F.lit(1)).cast("long")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)).cast("int") - 1))
        rows = rows.drop("i", "j").join(heavy.select(F.col("cell").alias("crowded"), n), F.col("cell") == F.col("crowded"), "left")
        rows = rows.withColumn("own", own).withColumn("other", other)
        rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    key = ("cell", "i", "j")
    columns = list(dict.fromkeys([*key, node, *lanes]))
    rows = rows.select(*columns).repartition(*key).sortWithinPartitions(*key)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def unpacked(table: pa.Table):
            """The rows' cells by number, their lanes and nodes, and where the last cell begins."""
            keys = [table.column(c).to_numpy() for c in key]
            new = np.zeros(table.num_rows, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            cells = np.cumsum(new)
            prints = np.stack([table.column(c).to_numpy() for c in lanes], axis=1).view(np.uint64)
            nodes, end = table.column(node).to_numpy(), int(np.searchsorted(cells, cells[-1]))
            return cells, prints, nodes, end

        def told(prints, cells, nodes):
            a, b = cell_edges(prints, cells, distance)
            return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], names=["a", "b"])

        def whole(batch):  # whether it holds rows of a cell that the rows held do not end in
            end, last = held[-1].slice(held[-1].num_rows - 1).to_pylist()[0], batch.slice(batch.num_rows - 1).to_pylist()[0]
            return any(end[c] != last[c] for c in key)

        for batch in batches:
            if not batch.num_rows:
                continue
            if held and not whole(batch):
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch])
            cells, prints, nodes, end = unpacked(table)
            yield told(prints[:end], cells[:end], nodes[:end])
            held = table.slice(end).combine_chunks().to_batches()
        if held:
            cells, prints, nodes, _ = unpacked(pa.Table.from_batches(held))
            yield told(prints, cells, nodes)

    return rows.mapInArrow(run, "a long, b long")


def groups_for(n: int, distance: int) -> int:
    """The number of groups that costs least for ``n`` fingerprints: copies of a row, each with its share of a cell to compare.

    A comparison is taken as 1/600 of a row's way through the shuffle.
    """

    def cost(groups: int) -> float:
        cell = n / 2 ** (SEGMENTS * SEGMENT_BITS * (groups - distance) / groups)
        return math.comb(groups, distance) * (1 + cell / 1200)

    return min(range(distance + 2, distance + 9), key=cost)


def links(prints: DataFrame, distance: int = 4, groups: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect the fingerprints of ``prints`` (one column, distinct) as links within ``distance`` do.

    More ``groups`` make more and smaller cells; the result has the same components for any number above ``distance``.
    """
    groups = groups_for(prints.count(), distance) if groups is None else groups
    bounds = [SEGMENTS * g // groups for g in range(groups + 1)]
    mask = lambda g: ((1 << 2 * bounds[g + 1]) - 1) ^ ((1 << 2 * bounds[g]) - 1)
    masks = [sum(map(mask, c)) for c in combinations(range(groups), groups - distance)]
    x = F.col(prints.columns[0])
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), signed(m).alias("mask")) for i, m in enumerate(masks)))
    counts = unary_column(x)
    cells = F.transform(choices, lambda m: F.xxhash64(m["choice"], counts.bitwiseAND(m["mask"])))
    return meet(prints.select(x.alias("x"), F.explode(cells).alias("cell")), "x", ["x"], distance, block)


def signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def similar_links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): edges that connect rows of ``prints`` (node, both fingerprints' lanes) as pairs within ``FAR`` bits do that meet in a cell."""
    n = max(2, prints.count())
    segments = SEGMENTS * PAIR_LANES
    chosen = min(segments, max(4, math.ceil(math.log2(n / UNRELATED) / SEGMENT_BITS)))
    tables = math.ceil(SHARED / STABLE**chosen)
    random, masks = np.random.default_rng(0), []
    for t in range(tables):
        lanes = [0] * PAIR_LANES
        for at in random.permutation(segments)[:chosen].tolist():
            lanes[at // SEGMENTS] |= 3 << 2 * (at % SEGMENTS)
        masks.append(F.struct(F.lit(t).alias("t"), *(signed(m).alias(c) for m, c in zip(lanes, PAIRS, strict=True))))
    counts = {c: unary_column(F.col(c)) for c in PAIRS}
    cell = F.explode(F.transform(F.array(*masks), lambda m: F.xxhash64(m["t"], *(counts[c].bitwiseAND(m[c]) for c in PAIRS))))
    return meet(prints.select("node", *PRINT, cell.alias("cell")), "node", PRINT, FAR, block)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 4, distance: int = 4, groups: int | None = None
) -> DataFrame:
    """(id, simhash, cluster, component_id) for each row of ``docs``.

    ``cluster`` names the component by its smallest fingerprint, ``component_id`` by its smallest id.
    """
    rows = cut(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", words, drop=("text",)))
    prints = rows.groupBy("simhash").agg(F.min("id").alias("first"))
    linked = components(links(prints.select("simhash"), distance, groups))
    named = joined_to_components(prints, "simhash", linked)
    named = named.select(F.col("simhash").alias("print"), "cluster", "component_id")
    found = rows.join(named, F.col("simhash") == F.col("print"))
    return found.select(F.col("id").alias(id_col), "simhash", "cluster", "component_id")


def joined_to_components(prints: DataFrame, node: str, linked: DataFrame) -> DataFrame:
    """``prints`` (node, first id and more) with cluster and component_id; only clusters of several nodes are summed up."""
    linked = cut(linked).withColumnRenamed("node", "node_of")
    named = prints.join(linked, F.col(node) == F.col("node_of"), "left")
    several = cut(named.where(F.col("component").isNotNull()).drop("node_of"))
    least = several.groupBy("component").agg(F.min("first").alias("component_id"))
    several = several.join(least, "component").withColumnRenamed("component", "cluster")
    single = named.where(F.col("component").isNull()).drop("node_of", "component")
    single = single.withColumns({"cluster": F.col(node), "component_id": F.col("first")})
    return several.unionByName(single)


def similar(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, node, cluster, component_id) for each row of ``docs``: groups of similarity 0.8 or more over five words.

    ``node`` stands for the fingerprint of ``LANES`` times 64 bits, as its 64-bit hash: V fingerprints are confused with a
    probability below V²/2^65.
    """
    rows = cut(sketches(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "text", drop=("text",)).withColumn("node", F.xxhash64(*PRINT)))
    prints = cut(rows.groupBy("node").agg(F.min("id").alias("first"), F.min(F.struct(*PRINT, *PAIRS)).alias("p")).select("node", "first", "p.*"))
    linked = components(similar_links(prints))
    named = joined_to_components(prints.select("node", "first"), "node", linked).withColumnRenamed("node", "of")
    found = rows.join(named, F.col("node") == F.col("of"))
    return found.select(F.col("id").alias(id_col), "node", "cluster", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of ``similar``: that of the smallest id (any id goes before null).

    Of rows that share a group's smallest id, the one whose JSON is first in code point order stays, so reruns agree. Only
    ids meet in the join that filters, except for rows whose id is null or repeated. Any other columns may be there.
    """
    inner, names = private(docs)
    key, content = F.col(names[id_col]), names[text]
    rows = cut(similar(docs.select(id_col, text), id_col, text).withColumnRenamed(id_col, "id"))
    odd = cut(rows.groupBy(F.col("id").alias("odd")).count().where((F.col("count") > 1) | F.col("odd").isNull()).select("odd"))
    stays = rows.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("stays"))
    if odd.isEmpty():
        return inner.join(stays, key == F.col("stays"), "left_semi").toDF(*docs.columns)
    plain = stays.join(odd, F.col("stays") == F.col("odd"), "left_anti")
    named = rows.select(F.col("node").alias("of"), "cluster", F.col("component_id").alias("least")).distinct()
    rest = inner.join(odd, key.eqNullSafe(F.col("odd")), "left_semi")
    rest = sketches(rest.select(F.struct(*inner.columns).alias("row"), key.alias("id"), F.col(content).alias("text")), "text", drop=("text",))
    rest = rest.join(named, F.xxhash64(*PRINT) == F.col("of")).where(F.col("id").eqNullSafe(F.col("least")))
    rest = rest.groupBy("cluster").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return inner.join(plain, key == F.col("stays"), "left_semi").unionByName(rest).toDF(*docs.columns)
