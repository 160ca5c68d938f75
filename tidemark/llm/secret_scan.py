"""Secret scans with corpus-wide ownership frequency (operator 8); DataFrame and SQL functions only.

Candidates are found by patterns over whole texts. Their values are then counted over the corpus by distinct owners and
by distinct repositories of an owner: a value in ``COPIED_OWNERS`` owners or ``COPIED_REPOSITORIES`` repositories is a
widely copied example, any other belongs to its owners and looks live. Base spans (``assign``, ``access``, ``hex``) are
always reported; the method adds ``literal`` spans, long mixed-case strings with digits, unless they are widely copied.
Each span's class is counted for the document, and ``redact`` masks examples otherwise than live-looking values.

Spans are code points, end exclusive. Spark gives no match positions, so a text is split by the pattern as well, and a
span begins after all gaps and matches before it; these lengths are summed by a window over the matches of a text.
Only copied values meet the spans in a join, in which Spark splits the partitions of hot values.

Defined results: a null text is the empty text; rows that agree in id and text are scanned once and get equal results; a
null owner or repository counts as one of its own; an empty table gives an empty result; ``report`` reads no other
columns and ``redact`` passes them through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, private

# The base patterns. Only the keyword's letters are matched in either case.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = f"({'|'.join(map(either_case, KEYWORDS))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LITERAL = r"[A-Za-z0-9+/_-]{20,}"
ASSIGN_LEAST, ACCESS_LEAST, DISTINCT_LEAST = 12, 18, 10
#: Kinds in the order in which spans that begin together are listed.
KINDS = ("assign", "access", "hex", "literal")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, LITERAL), strict=True))
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 10
MASK, EXAMPLE = "[REDACTED]", "[EXAMPLE]"
FEW = 100_000  # rows of about 100 bytes that may be broadcast


def _matches(text: Column, kind: str) -> Column:
    """Of one kind: (gap before, length, kept, hash of the value) of each match, in order."""
    pattern = F.lit(PATTERNS[kind])
    found, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    values = F.regexp_extract_all(text, pattern, F.lit(2)) if kind == "assign" else found
    value = lambda i: F.get(values, i)
    kept = {
        "assign": lambda v: F.length(v) >= ASSIGN_LEAST,
        "access": lambda v: F.length(v) >= ACCESS_LEAST,
        "hex": lambda v: F.lit(True),
        "literal": lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
        & (F.size(F.array_distinct(F.split(v, ""))) >= DISTINCT_LEAST),
    }[kind]
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"),
            F.length(m).alias("n"), kept(value(i)).alias("kept"), F.xxhash64(value(i)).alias("value"),
        ),
    )


def scan(docs: DataFrame, id_col: str, text: str, owner: str, repository: str) -> DataFrame:
    """(id, tag, owner, repository, found) for each row; no text. ``tag`` with the id stands for the text."""
    content = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,n:int,kept:boolean,value:bigint>>")
    may = {k: content.rlike(p) for k, p in PATTERNS.items()} | {"access": F.contains(content, F.lit("AKIA"))}
    each = [F.when(may[k], _matches(content, k)).otherwise(none) for k in KINDS]
    return docs.select(
        F.col(id_col), F.xxhash64(content).alias("tag"), F.col(owner).alias("owner"),
        F.col(repository).alias("repository"), F.concat(*each).alias("found"),
    )


def candidates(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, tag, owner, repository, kind, start, end, value) for each span of distinct (id, tag)."""
    one = rows.where(F.exists("found", lambda m: m["kept"])).dropDuplicates([id_col, "tag", "owner", "repository"])
    by = Window.partitionBy(id_col, "tag", "owner", "repository", "kind").orderBy("i")
    spans = one.select(id_col, "tag", "owner", "repository", F.inline("found"))
    return (
        spans.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(by))
        .where("kept")
        .select(id_col, "tag", "owner", "repository", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "value")
    )


def copied_values(spans: DataFrame) -> DataFrame:
    """(copied): values that are widely copied. Each level sums what the one before has left, so no value meets in one task."""
    held = spans.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    held = held.groupBy("value", "owner").agg(F.count("*").alias("n"))
    held = held.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES)
    return held.where(copied).select(F.col("value").alias("copied"))


def spans_of(docs: DataFrame, id_col: str, text: str, owner: str, repository: str) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): every row as (id, tag, any), and the reported spans (id, tag, kind, start, end, copied)."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(owner).alias("of"), F.col(repository).alias("in"))
    rows = cut(scan(docs, "id", "text", "of", "in"))
    found = cut(candidates(rows, "id"))
    copied = copied_values(found).hint("merge")
    found = found.select("id", "tag", "kind", "start", "end", "value").join(copied, F.col("value") == F.col("copied"), "left")
    found = found.where((F.col("kind") < KINDS.index("literal")) | F.col("copied").isNull())
    found = found.groupBy("id", "tag", "kind", "start", "end").agg(F.max(F.col("copied").isNotNull()).alias("copied"))
    return rows.select("id", "tag", F.exists("found", lambda m: m["kept"]).alias("any")), found


def _listed(rows: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """For each row: id, n_assign, n_access, n_hex, n_literal, n_copied, n_owned, base_sha256, spans."""
    rows, found = spans_of(docs, id_col, text, owner, repository)
    n = lambda c: F.count_if(c)
    per = found.groupBy(F.col("id").alias("k"), F.col("tag").alias("t")).agg(
        *(n(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        n(F.col("copied")).alias("n_copied"), n(~F.col("copied")).alias("n_owned"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("list"),
    )
    per = per.withColumn("base", F.filter("list", lambda x: x["kind"] < KINDS.index("literal"))).hint("merge")
    counts = [*(f"n_{k}" for k in KINDS), "n_copied", "n_owned"]
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    clean = rows.where(~F.col("any")).select(
        "id", *(F.lit(0).cast("long").alias(c) for c in counts), digest(F.lit("")).alias("base_sha256"), F.lit("").alias("spans")
    )
    hit = rows.where("any").join(per, F.col("id").eqNullSafe(F.col("k")) & (F.col("tag") == F.col("t")), "left")
    hit = hit.select(
        "id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        digest(F.coalesce(_listed(F.col("base")), F.lit(""))).alias("base_sha256"), F.coalesce(_listed(F.col("list")), F.lit("")).alias("spans"),
    )
    return clean.unionByName(hit).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """``docs`` with every reported span of its texts masked; spans that touch or overlap get one mask, ``EXAMPLE`` if all of
    them are widely copied. A null text stays null.

    The texts are searched once; masks come back by id and the text's hash, broadcast if they are ``FEW``.
    """
    inner, names = private(docs)
    _, found = spans_of(docs, id_col, text, owner, repository)
    by = Window.partitionBy("id", "tag").orderBy("start", "end")
    past = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.when(F.col("start") <= past, 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    masks = cut(
        islands.groupBy("id", "tag", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("copied").alias("copied"))
        .groupBy(F.col("id").alias("k"), F.col("tag").alias("t"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end", "copied"))).alias("masks"))
    )
    masks = F.broadcast(masks) if masks.limit(FEW + 1).count() <= FEW else masks.hint("merge")
    content = F.coalesce(F.col(names[text]), F.lit(""))
    joined = inner.join(masks, F.col(names[id_col]).eqNullSafe(F.col("k")) & (F.xxhash64(content) == F.col("t")), "left")
    before = F.transform("masks", lambda m, i: F.struct(F.when(i > 0, F.get(F.col("masks"), i - 1)["end"]).otherwise(0).alias("from"), m["start"].alias("to"), F.when(m["copied"], EXAMPLE).otherwise(MASK).alias("mask")))
    cut_out = lambda a, b: F.substring(content, (a + 1).cast("int"), (b - a).cast("int"))
    pieces = F.transform(before, lambda m: F.concat(cut_out(m["from"], m["to"]), m["mask"]))
    masked = F.concat(F.array_join(pieces, ""), cut_out(F.element_at("masks", -1)["end"], F.length(content).cast("long")))
    new = F.when(F.col("masks").isNull(), F.col(names[text])).otherwise(masked)
    return joined.select(*(new.alias(n) if c == text else F.col(n) for c, n in names.items())).toDF(*docs.columns)


def _oracle() -> str:
    quoted = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    parts = []
    for i, kind in enumerate(KINDS):
        value = "v" if kind == "assign" else "m"
        keep = {
            "assign": f"len(v) >= {ASSIGN_LEAST}", "access": f"len(m) >= {ACCESS_LEAST}", "hex": "true",
            "literal": f"regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]') "
            f"and len(list_distinct(string_split(m, ''))) >= {DISTINCT_LEAST}",
        }[kind]
        parts.append(f"""
  select doc_id, source, {i} as kind, e - len(m) as s, e, {value} as value from (
    select doc_id, source, m, v, sum(len(g) + len(m)) over (partition by doc_id order by i) as e from (
      select doc_id, source, unnest(ms) as m, unnest(vs) as v, unnest(gs[1:len(ms)]) as g, unnest(range(len(ms))) as i from (
        select doc_id, source, regexp_extract_all(text, '{quoted[kind]}') as ms,
               regexp_extract_all(text, '{quoted[kind]}', {2 if kind == "assign" else 0}) as vs,
               string_split_regex(text, '{quoted[kind]}') as gs
        from documents where regexp_matches(text, '{quoted[kind]}')))) where {keep}""")
    names = "case kind " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
    item = f"concat({names}, ':', s::bigint, ':', e::bigint)"
    return f"""
with found as ({" union all ".join(parts)}),
held as (
  select value, count(distinct source) >= {COPIED_OWNERS} or count(distinct struct_pack(a := source, b := doc_id)) >= {COPIED_REPOSITORIES} as copied
  from found group by value),
kept as (select f.*, copied from found f join held h on f.value = h.value where kind < 3 or not copied),
per as (
  select doc_id, {", ".join(f"count(*) filter (where kind = {i}) as n_{k}" for i, k in enumerate(KINDS))},
         count(*) filter (where copied) as n_copied, count(*) filter (where not copied) as n_owned,
         coalesce(string_agg({item}, ',' order by s, kind, e) filter (where kind < 3), '') as base,
         string_agg({item}, ',' order by s, kind, e) as spans
  from kept group by doc_id)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in KINDS)},
       coalesce(n_copied, 0)::bigint as n_copied, coalesce(n_owned, 0)::bigint as n_owned,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join per p on d.doc_id = p.doc_id
"""


ORACLE = _oracle()
