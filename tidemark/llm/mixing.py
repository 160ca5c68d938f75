"""Mixing sources to target weights by hash-threshold histograms (operator 9); DataFrame and SQL functions only.

Sizes are words. Sources in code point order, null last, weigh 5, 2, 1, repeating, and share all words of all sources;
no target exceeds three times its source's size, and what it would have had more is shared again by weight. A source
whose target is r times its size takes each document floor(r) times, and once more the documents whose hash lies under
a threshold. The threshold comes from histograms of words by source and hash bucket: 12 bits of the hash at a time, each
level looks only into the bucket in which the remaining budget ends. Nothing is sorted but histograms, and the texts are
read once.

Defined results: a null text has size 0 and takes 0 words; a null id counts as the text 'null'; rows that agree in id and
text share a hash; where the budget ends among such rows, as many of them are taken as come nearest to the target (they are numbered
by the part of the table that holds them, only there); an empty table gives an empty result; ``mix`` reads no other
columns and ``resample`` passes them through. Reruns agree, as the hash depends on id and text alone, and so does the number of equal rows taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
MOST = 3
LEVEL_BITS, LEVELS = 12, 5
FEW = 10_000  # sources, of about 50 bytes each
HEX = LEVEL_BITS * LEVELS // 4


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with target.

    Sources that reach their limit come first when ordered by limit over weight; the rest share what is left. ``level``
    is the words for each unit of weight once all sources before this one have reached their limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight.cast("long"))
        .withColumn("ratio", F.col("source_size") * float(MOST) / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(all_rows) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("weights"))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(all_rows)
    return ranked.select(
        "source", "source_size", F.least(F.col("source_size") * float(MOST), level["level"] * F.col("weight")).alias("target")
    )


def bucketed(docs: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """``docs`` with ``size`` and ``hash``, the latter HEX hex digits of an MD5 of the id and the text's MD5."""
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    digits = F.substring(F.md5(key), 1, HEX)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"size": size, "hash": F.conv(digits, 16, 10).cast("long")})


def thresholds(rows: DataFrame) -> DataFrame:
    """(s, source_size, target, whole, edge, some, members) for each source of ``rows`` (source, size, hash): once more are taken
    the rows whose hash is below ``edge``, and of the ``members`` rows at it ``some``."""
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole)
    plan = plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = cut(plan.withColumn("prefix", F.lit(0).cast("long")))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        here = rows.select(F.col("source").alias("s"), "size", F.shiftright("hash", shift).alias("bucket"))
        edges = plan.select("source", "prefix", "budget")
        if level:  # only the bucket in which the budget ends
            inside = F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("prefix"))
            here = here.join(_small(edges), inside, "left_semi")
        sums = here.groupBy("s", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("members"))
        before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        # the last bucket that begins within the budget is the one in which it ends
        edge = (
            sums.join(edges, F.col("s").eqNullSafe(F.col("source")))
            .where(F.col("before") <= F.col("budget"))
            .groupBy("s").agg(F.max(F.struct("bucket", "before", "words", "members")).alias("edge"))
        )
        plan = cut(
            plan.join(edge, F.col("s").eqNullSafe(F.col("source")), "left").select(
                "source", "source_size", "target", "whole",
                (F.col("budget") - F.coalesce("edge.before", F.lit(0))).alias("budget"),
                F.coalesce("edge.bucket", F.lit(0)).alias("prefix"),
                F.coalesce("edge.words", F.lit(0)).alias("words"), F.coalesce("edge.members", F.lit(0)).alias("members"),
            )
        )
    # of the rows at the edge, which are equal, as many as come nearest
    nearest = F.ceil((2 * F.col("budget") * F.col("members") - F.col("words")) / (2 * F.col("words")))
    some = F.when(F.col("words") > 0, nearest).otherwise(F.when(F.col("budget") > 0, F.col("members")).otherwise(0))
    some = F.greatest(F.lit(0), F.least(some, F.col("members"))).cast("long")
    return cut(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", F.col("prefix").alias("edge"), some.alias("some"), "members"))


def _small(plan: DataFrame) -> DataFrame:
    """``plan`` marked for broadcast if it has at most FEW rows; beyond that Spark shuffles and splits skewed sources."""
    return F.broadcast(plan) if plan.limit(FEW + 1).count() <= FEW else plan


def with_copies(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """``rows`` (hash, ``source`` and more) with the plan's columns and ``copies``.

    Rows at an edge are numbered only where several are there of which some but not all are taken: by the table's parts,
    so that a hot row's copies are never in one task.
    """
    split = plan.where((F.col("some") > 0) & (F.col("some") < F.col("members")))
    more = (F.col("hash") < F.col("edge")) | ((F.col("hash") == F.col("edge")) & (F.col("some") > 0))
    copies = lambda once: F.least(F.col("whole") + F.when(once, 1).otherwise(0), F.lit(MOST).cast("long"))
    joined = rows.join(_small(plan), F.col(source).eqNullSafe(F.col("s")))
    if split.isEmpty():
        return joined.withColumn("copies", copies(more))
    at_edge = (F.col("hash") == F.col("edge")) & (F.col("some") > 0) & (F.col("some") < F.col("members"))
    equal = cut(joined.where(at_edge).withColumn("_row", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_row", 33))
    parts = equal.groupBy("s", "_part").agg(F.count("*").alias("_k"))
    before = Window.partitionBy("s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("s").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("s", "_part").orderBy("_row"))
    equal = equal.withColumn("_place", place).join(parts, F.col("s").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    equal = equal.withColumn("copies", copies(F.col("_place") + F.col("_before") <= F.col("some"))).drop("_row", "_part", "_place", "_s", "_p", "_before")
    return joined.where(~at_edge).withColumn("copies", copies(more)).unionByName(equal)


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, copies) for each row of ``docs``."""
    docs = docs.select(F.col(id_col), F.col(text).alias("_text"), F.col(source).alias("source"))
    rows = cut(bucketed(docs, id_col, "_text", "source").select(id_col, "source", "size", "hash"))
    found = with_copies(rows, thresholds(rows), "source")
    return found.select(id_col, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def resample(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with each row as many times as the mix takes it; columns as they are."""
    narrow = docs.select(F.col(id_col), F.col(text).alias("_text"), F.col(source).alias("source"))
    rows = cut(bucketed(narrow, id_col, "_text", "source").select("source", "size", "hash"))
    plan = thresholds(rows).select("s", "whole", "edge", "some", "members")
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # so that no column of docs clashes
    inner = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    inner = with_copies(bucketed(inner, names[id_col], names[text], names[source]), plan, names[source])
    inner = inner.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return inner.select(*(F.col(n).alias(c) for c, n in names.items()))


#: The same rule by a running sum over each source's documents in hash order.
ORACLE = f"""
with rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':' || md5(coalesce(text, ''))), 1, {HEX}))::bigint as hash
  from documents),
sizes as (select source, sum(size)::bigint as source_size from rows group by source),
ranked as (
  select *, row_number() over (order by source nulls last) - 1 as place from sizes),
weighed as (
  select *, case place % 3 when 0 then 5 when 1 then 2 else 1 end::bigint as weight,
         source_size * {MOST}::double / (case place % 3 when 0 then 5 when 1 then 2 else 1 end) as ratio from ranked),
levels as (
  select *, ((sum(source_size) over ())::double - {MOST} * coalesce(sum(source_size) over w, 0)::double)
         / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as level
  from weighed window w as (order by ratio, place rows between unbounded preceding and 1 preceding)),
chosen as (select level from levels where level <= ratio order by ratio, place limit 1),
targets as (
  select l.source, source_size, least(source_size * {MOST}::double, c.level * weight) as target from levels l, chosen c),
plan as (
  select *, case when source_size = 0 then 0 else floor(target / source_size) end::bigint as whole from targets),
summed as (
  select source, hash, sum(size)::bigint as words, count(*) as k,
         coalesce(sum(sum(size)) over (partition by source order by hash rows between unbounded preceding and 1 preceding), 0)
           as before
  from rows group by source, hash),
placed as (
  select r.doc_id, r.size, p.source_size, p.target, p.whole, s.words, s.k, p.target - p.whole * p.source_size - s.before as budget,
         row_number() over (partition by r.source, r.hash order by r.doc_id) as place
  from rows r join plan p on r.source is not distinct from p.source
  join summed s on r.source is not distinct from s.source and r.hash = s.hash),
taken as (
  select doc_id, size, source_size, target,
         least({MOST}, whole + case when words = 0 then (budget > 0)::bigint when place <= ceil((2 * budget * k - words) / (2 * words)) then 1 else 0 end)
           as copies
  from placed)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies::bigint as copies from taken
"""
