"""A Merkle manifest of a dataset by Pregel-style supersteps over an RDD of blocks (operator 13).

A row's leaf is the SHA-256 of its columns. Leaves are ordered within their group, and runs of FAN consecutive nodes become
their hash until one node is left, the group's subroot; the subroots, in the order of their groups, give the root in the same
way. Hashes are lowercase hex text, and a hash of hashes is that of their texts, joined.

A vertex is a block of WIDTH = FAN**LEVELS consecutive nodes of a group, so that a superstep covers LEVELS levels and a block
is bounded. Going up, children message their block (a task joins the messages that it has for a block into one); a
block that has its children hashes them and forwards its top to the block above. A group whose nodes fit one
block is complete and halts. In the reverse supersteps a block sends each child the siblings on the way from it to the root; the lowest
blocks fold them over the leaves that are to be verified. Leaves, which are by far the most, move once, in blocks; nothing
but the number of leaves and groups comes to the driver.

Positions come from one range partitioning by group and order: rows are written in ranges, and only the number of rows of
each range and group goes through windows. Rows that are equal in all columns may be split between ranges.

Defined results: a null column enters a leaf as ``-``, any other as its length in UTF-8 bytes, ``:`` and its text; null
groups are a group of their own, the first; rows without an id come first in their group; rows of one id are ordered by leaf,
so that the root does not depend on the order of the input; repeated rows are leaves each; a group of one row is its own subroot; an
empty table gives an empty result; columns that are not named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, key_text, n_partitions

FAN, LEVELS = 8, 3
WIDTH = FAN**LEVELS
FEW = 10_000  # ranges and groups, of about 60 bytes each


def digest(*parts: bytes) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf(columns: list[Column]) -> Column:
    """The SHA-256 of the columns, 32 bytes."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_pos``, the place in the group from 0, and ``_n``, the group's size."""
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_tie")]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n_partitions(rows.sparkSession), *keys)
    ranged = ranged.sortWithinPartitions(*keys).drop("_tie").withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    ranged = cut(ranged)
    whole = Window.partitionBy("_g")
    before = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    sizes = sizes.select("_g", "_p", "_first", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(whole).alias("_n"))
    sizes = cut(sizes)
    few = F.broadcast(sizes) if sizes.limit(FEW + 1).count() <= FEW else sizes
    found = ranged.join(few, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return found.withColumn("_pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_g", "_p", "_part", "_at", "_first", "_before")


def place(key: tuple) -> int:
    """Which partition a block belongs to."""
    return zlib.crc32(repr(key).encode())


def levels(n: int, nodes: list[bytes]) -> list[list[bytes]]:
    """A block's nodes and the levels above them: LEVELS of them, or up to one node in a block that holds its whole group."""
    out = [nodes]
    while len(out) <= LEVELS and (n > WIDTH or len(out[-1]) > 1):
        below = out[-1]
        out.append([digest(*below[i : i + FAN]) for i in range(0, len(below), FAN)])
    return out


def path(found: list[list[bytes]], slot: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of the node at ``slot`` in its run, and so on up to the block's top."""
    out = []
    for level in found[:-1]:
        first = slot // FAN * FAN
        out.append((b"".join(level[first:slot]), b"".join(level[slot + 1 : first + FAN])))
        slot //= FAN
    return out


def messages(rows: Iterator) -> Iterator[tuple]:
    """Rows (group, position, size, digest, more) as messages to their blocks; consecutive ones of a block are one message."""
    key, held, size = None, [], 0
    for group, pos, n, node, more in rows:
        to = (group, pos // WIDTH)
        if held and to != key:
            yield key, (size, held)
            held = []
        key, size = to, n
        held.append((pos % WIDTH, node, more))
    if held:
        yield key, (size, held)


def received(parts) -> tuple[int, list]:
    """A block: the size of its group on this level and its children by slot."""
    parts = list(parts)
    return parts[0][0], sorted((x for _, held in parts for x in held), key=lambda x: x[0])


def up(block: tuple) -> Iterator[tuple]:
    (group, b), (n, children) = block
    if n > WIDTH:
        top = levels(n, [x[1] for x in children])[-1][0]
        yield (group, b // WIDTH), (-(-n // WIDTH), [(b % WIDTH, top, None)])


class Forest:
    """The blocks of every superstep upward. ``rows`` holds (group, position, size of the group, digest, more)."""

    def __init__(self, rows: RDD, n_rows: int, n_groups: int, most: int, partitions: int):
        self.steps: list[tuple[RDD, int]] = []
        sent = rows.mapPartitions(messages)
        while True:
            n_rows = -(-n_rows // WIDTH) + n_groups  # blocks at most
            parts = max(1, min(partitions, n_rows))
            blocks = sent.groupByKey(parts, place).mapValues(received)
            self.steps.append((blocks, parts))
            if most <= WIDTH:
                break
            most, sent = -(-most // WIDTH), blocks.flatMap(up)

    def tops(self) -> RDD:
        """(group, step in which it halted, its top) of every group."""
        found = [blocks.filter(lambda x: x[1][0] <= WIDTH).map(lambda x, s=s: (x[0][0], s, levels(x[1][0], [c[1] for c in x[1][1]])[-1][0])) for s, (blocks, _) in enumerate(self.steps)]
        return found[0].context.union(found)

    def down(self, told: RDD) -> RDD:
        """(digest, more, facts, path) of every leaf; ``told`` holds (group, step, facts, path above the group's top)."""
        arrived = None
        for s in range(len(self.steps) - 1, -1, -1):
            blocks, parts = self.steps[s]
            to_tops = told.filter(lambda x, s=s: x[1] == s).map(lambda x: ((x[0], 0), (x[2], x[3])))
            arrived = to_tops if arrived is None else arrived.union(to_tops)
            # both sides are dealt alike, so that the blocks stay where they are
            both = blocks.mapValues(lambda x: (0, x)).union(arrived.mapValues(lambda x: (1, x)).partitionBy(parts, place))
            arrived = both.groupByKey(parts, place).flatMap(to_children if s else to_leaves)
        return arrived


def to_children(met: tuple) -> Iterator[tuple]:
    (group, b), two = met
    (n, children), (facts, above) = (x for _, x in sorted(two, key=lambda x: x[0]))
    found = levels(n, [x[1] for x in children])
    for at, (slot, _, _) in enumerate(children):
        yield (group, b * WIDTH + slot), (facts, path(found, at) + above)


def to_leaves(met: tuple) -> Iterator[tuple]:
    (n, children), (facts, above) = (x for _, x in sorted(met[1], key=lambda x: x[0]))
    found = levels(n, [x[1] for x in children])
    for at, (_, node, more) in enumerate(children):
        yield node, more, facts, path(found, at) + above


def folded(node: bytes, steps: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in steps:
        node = digest(left, node, right)
    return node


def forest(rows: DataFrame, group: str, order: list[str], node: str, more: list[str]) -> tuple[Forest, int]:
    """The forest of ``rows``, whose ``node`` has digests of 32 bytes, and its number of groups."""
    found = numbered(rows, group, order)
    n_rows, n_groups, most = found.agg(F.count("*"), F.count_if(F.col("_pos") == 0), F.max("_n")).first()
    sent = found.select(group, "_pos", "_n", node, *more).rdd.map(lambda r: (r[0], r[1], r[2], r[3].hex().encode(), tuple(r[4:])))
    return Forest(sent, n_rows, n_groups, most or 0, n_partitions(rows.sparkSession)), n_groups


def verify(docs: DataFrame, presented: dict[str, Column], columns: list[str], id_col: str = "doc_id", group: str = "lang") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified, n_siblings, height) for each row of ``docs``.

    The manifest is that of the rows as they are. ``presented`` names the columns that the rows to be verified have otherwise,
    with their expressions; each such row is folded with the manifest's siblings, and verified if that gives the root.
    """
    spark = docs.sparkSession
    there = leaf([presented.get(c, F.col(c)) for c in columns])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(group).cast("string").alias("_group"), leaf([F.col(c) for c in columns]).alias("_leaf"), there.alias("_there"))
    rows = cut(rows.withColumn("_there", F.when(F.col("_there") != F.col("_leaf"), F.col("_there"))))
    below, n_groups = forest(rows, "_group", ["_id", "_leaf"], "_leaf", ["_id", "_there"])
    kind = docs.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, kind)] + [T.StructField(n, T.StringType()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
        + [T.StructField("verified", T.BooleanType()), T.StructField("n_siblings", T.LongType()), T.StructField("height", T.LongType())]
    )
    if not n_groups:
        return spark.createDataFrame([], schema)
    tops = below.tops().map(lambda x: (x[0], x[1], bytes.fromhex(x[2].decode())))
    tops = cut(spark.createDataFrame(tops, "_group string, _step int, _top binary", verifySchema=False).withColumn("_all", F.lit(0)))
    above, _ = forest(tops, "_all", ["_group"], "_top", ["_group", "_step"])
    from_root = above.down(above.tops().map(lambda x: (x[0], x[1], (x[2],), [])))
    told = from_root.map(lambda x: (x[1][0], x[1][1], (x[0], x[2][0]), x[3]))

    def row(x: tuple) -> tuple:
        node, (key, other), (subroot, root), steps = x
        at = folded(node if other is None else other.hex().encode(), steps)
        siblings = [y for pair in steps for y in pair]
        proof = digest(*siblings)
        return (key, *(y.decode() for y in (node, subroot, root, proof, at)), at == root, sum(map(len, siblings)) // len(root), len(steps))

    return spark.createDataFrame(below.down(told).map(row), schema, verifySchema=False)


def tampered(id_col: str = "doc_id") -> Column:
    """The rows that the registered query tampers with: 3 divides the crc32 of the id's text; a null id counts as ''."""
    return F.crc32(key_text(id_col).cast("binary")) % 3 == 0
