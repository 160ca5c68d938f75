"""Complexity from observed effort, semantic classification, and audits of a taxonomy against clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.money import filled
from tidemark.functions.text import INTENT_ORDER, is_acknowledgement, is_notification, lexical_evidence, without_notes
from tidemark.operators.quantiles import ranks
from tidemark.operators.semantic import PRIME_WEIGHT, TAU, labelled, scored

# Thresholds of the audit's findings.
TOP_TERMS, TOP_REPRESENTATIVES = 8, 3
MERGE_SHARE, SPLIT_SHARE, SPLIT_CLUSTERS, SPLIT_PROMPTS = 0.20, 0.50, 3, 12
MIXED_PURITY, LATENT_PURITY = 0.40, 0.50
LEXICAL = ("ops", "feedback")
TERM = r"(?U)[^\W\d_]{3,}"
# Words too common to tell clusters apart.
STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "you", "your", "are", "but", "not", "can", "all", "any", "from", "have", "has", "was", "will",
    "what", "why", "how", "when", "which", "should", "would", "could", "into", "out", "then", "than", "them", "they", "there", "here", "its", "our",
    "use", "using", "make", "made", "get", "got", "want", "need", "like", "just", "also", "more", "most", "some", "one", "two", "now", "new", "add",
    "put", "let", "see", "via", "per", "yes", "okay", "les", "des", "une", "que", "qui", "pour", "dans", "avec", "sur", "pas", "est", "sont", "fait",
    "faire", "fais", "plus", "moins", "mais", "donc", "car", "comme", "tout", "tous", "toute", "cette", "ces", "son", "ses", "leur", "vous", "nous",
    "elle", "ici", "etre", "etait", "avoir", "deja", "encore", "bien", "tres", "peux", "peut", "veux", "veut", "oui", "non", "ton", "tes", "mon",
    "mes", "par", "aux",
)


def complexity(prompts: DataFrame) -> DataFrame:
    """(prompt_id, complexity): the mean band of turns, tool calls, characters and units, rounded half to even.

    A value's band is 1 to 5 by the share of prompts that have no more: up to 0.2, 0.4, 0.6, 0.8 and beyond; 3 for all if there
    is one value only. The four limits of each measure are ranks, found for all measures at once; no prompt is sorted.
    """
    names = ("assistant_turns", "tool_calls", "char_count", "units")
    rows = prompts.select("prompt_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))
    long_ = rows.select(F.inline(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias("v")) for n in names))))

    def beyond(share: float) -> Column:  # the place of the first value that more than this share don't exceed
        near = F.floor(F.col("_n") * F.lit(share))
        more = lambda k: (k.cast("double") / F.col("_n")) <= F.lit(share)  # noqa: E731  the comparison that defines a band
        return F.when(more(near + 1), near + 1).when(more(near), near).otherwise(near - 1)

    limits = {f"t{i}": beyond(x) for i, x in enumerate((0.2, 0.4, 0.6, 0.8))}
    found = ranks(long_, ["measure"], "v", {"least": F.lit(0), "most": F.col("_n") - 1} | limits)
    of = lambda n: F.max(F.when(F.col("measure") == n, F.struct("least", "most", *limits))).alias(f"_{n}")
    out = rows.crossJoin(F.broadcast(found.agg(*map(of, names))))  # one row

    def band(n: str) -> Column:
        above = sum((F.when(F.col(n) >= F.col(f"_{n}.{t}"), 1).otherwise(0) for t in limits), F.lit(1))
        return F.when(F.col(f"_{n}.least") == F.col(f"_{n}.most"), 3).otherwise(above)

    return out.select("prompt_id", F.bround(sum(map(band, names), F.lit(0)) / 4, 0).cast("int").cast("string").alias("complexity"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, from the first component to the last."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean vector of each label, by component, so no group is gathered."""
    parts = vectors.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("place", "x"))
    # to 2**-40, so that sums don't depend on order
    means = parts.groupBy(label, "place").agg((F.sum(F.round(F.col("x") * 2**40).cast("decimal(38,0)")).cast("double") / F.count("*") / 2**40).alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("centroid"))


def representatives(vectors: DataFrame, id_col: str, label: str, vector: str, top: int = TOP_REPRESENTATIVES) -> DataFrame:
    """(label, rank, id): the members nearest to their label's centroid."""
    rows = vectors.join(centroids(vectors, label, vector), label).select(label, id_col, F.round(dot(F.col(vector), F.col("centroid")), 6).alias("score"))
    order = Window.partitionBy(label).orderBy(F.desc("score"), id_col)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(label, "rank", id_col)


def top_terms(docs: DataFrame, label: str, text: str, top: int = TOP_TERMS) -> DataFrame:
    """(label, rank, term): the terms that are frequent in a label and in few labels; ties by term."""
    words = docs.select(label, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term"))
    counts = words.where(~F.col("term").isin(*STOP_WORDS)).groupBy(label, "term").agg(F.count("*").alias("n"))
    spread = counts.groupBy("term").agg(F.count("*").alias("labels"))
    sizes = counts.groupBy(label).agg(F.sum("n").alias("total"))
    rows = counts.join(spread, "term").join(sizes, label).crossJoin(docs.select(label).distinct().agg(F.count("*").alias("all_labels")))  # one row
    score = F.round(F.col("n").cast("double") / F.col("total") * F.log(1 + F.col("all_labels").cast("double") / F.col("labels")), 9)
    order = Window.partitionBy(label).orderBy(F.desc("score"), "term")
    ranked = rows.withColumn("score", score).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top).select(label, "rank", "term")


def crosstab(rows: DataFrame, cluster: str, category: str) -> DataFrame:
    """(cluster, category, n, size, share, dominant): counts of categories in clusters; ties of dominance go to the first by
    the fixed order of intents, then by name. Noise, cluster -1, is left out."""
    counts = rows.where(F.col(cluster) != -1).groupBy(F.col(cluster).alias("cluster"), filled(category, "other").alias("category")).agg(F.count("*").alias("n"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, INTENT_ORDER)), F.col("category")), F.lit(0)), F.lit(99))
    best = F.first("category").over(Window.partitionBy("cluster").orderBy(F.desc("n"), place, "category"))
    size = F.sum("n").over(Window.partitionBy("cluster"))
    return counts.withColumns({"size": size, "dominant": best}).withColumn("share", F.col("n").cast("double") / F.col("size"))


def merges(table: DataFrame, least: float = MERGE_SHARE) -> DataFrame:
    """(cluster, categories): clusters of which at least two categories own a fair share each."""
    rows = table.where((F.col("category") != "other") & (F.col("share") >= least)).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))).alias("c"))
    return rows.where(F.size("c") >= 2).select("cluster", F.array_join(F.col("c.category"), ",").alias("categories"))


def splits(table: DataFrame, most: float = SPLIT_SHARE, clusters: int = SPLIT_CLUSTERS, prompts: int = SPLIT_PROMPTS) -> DataFrame:
    """(category, clusters, top_share): categories in several clusters none of which holds most of it."""
    rows = table.where(~F.col("category").isin("other", "followup", "notification")).groupBy("category").agg(F.count("*").alias("clusters"), F.sum("n").alias("all"), F.max("n").alias("top"))
    share = F.col("top").cast("double") / F.col("all")
    return rows.where((F.col("all") >= prompts) & (F.col("clusters") >= clusters) & (share < most)).select("category", "clusters", F.round(share, 6).alias("top_share"))


def themes(table: DataFrame) -> DataFrame:
    """(cluster, kind, purity): clusters of nothing known, and clusters of everything."""
    rows = table.where(F.col("category") == F.col("dominant"))
    latent = (F.col("dominant") == "other") & (F.col("share") >= LATENT_PURITY)
    kind = F.when(latent, "latent-other").when(F.col("share") < MIXED_PURITY, "cross-cutting")
    return rows.where(kind.isNotNull()).select("cluster", kind.alias("kind"), F.round("share", 6).alias("purity"))


def semantic(prompts: DataFrame, prototypes: DataFrame, text: str, vector: str, tau: float = TAU, prime: float = PRIME_WEIGHT, top: int = 1) -> DataFrame:
    """``prompts`` with ``label``: the category whose ``top`` nearest unit ``prototypes`` (category, vector) have the largest
    mean cosine, against lexical evidence for some categories; other below ``tau``. Prototypes are a small table that the
    caller configures."""
    rows, names = scored(prompts, prototypes, vector, top, "_scores")
    clean = without_notes(F.col(text))
    shortcut = F.when(is_notification(F.col(text)), "notification").when(is_acknowledgement(F.col(text)), "followup")
    return labelled(rows, names, "_scores", {n: lexical_evidence(clean, n) for n in LEXICAL}, shortcut, tau, prime).drop("_scores")


def merge_categories(old: DataFrame, new: DataFrame, rank: dict[str, int]) -> DataFrame:
    """``old`` categories with those of ``new`` in their place where the new classifier's ``rank`` is at least the old one's.

    Classifiers are known by the part of their name before the first hyphen.
    """
    level = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.split(c, "-")[0]), F.lit(-1))
    columns = ["category", "complexity", "classifier_model", "classified_at"]
    both = old.alias("o").join(new.alias("n"), "prompt_id", "full")
    takes = F.col("o.classifier_model").isNull() | (F.col("n.classifier_model").isNotNull() & (level(F.col("n.classifier_model")) >= level(F.col("o.classifier_model"))))
    return both.select("prompt_id", *(F.when(takes, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(first, second, n): how often two label tables (prompt_id, category) agree and differ."""
    return a.select("prompt_id", F.col("category").alias("first")).join(b.select("prompt_id", F.col("category").alias("second")), "prompt_id").groupBy("first", "second").agg(F.count("*").alias("n"))


def reconcile(ours: DataFrame, theirs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two totals side by side with their difference, rows that only one has included."""
    a, b = ours.select(*keys, F.col(value).alias("ours")), theirs.select(*keys, F.col(value).alias("theirs"))
    both = a.join(b, keys, "full")
    return both.select(*keys, F.coalesce("ours", F.lit(0)).alias("ours"), F.coalesce("theirs", F.lit(0)).alias("theirs"), (F.coalesce("ours", F.lit(0)) - F.coalesce("theirs", F.lit(0))).alias("difference"))
