"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size. Documents of a
source stand in a fixed order (by size class, so that any stretch of the order is alike in size; then by
hash and id); the running total of expected copies gets one offset per source, drawn by hash from the
seed, and a document is emitted once for each whole number that its stretch crosses.

The order is dealt in (source, size class, hash part) buckets: counts per bucket are aggregated first and
their running total within the source gives each bucket its first rank, so no task holds a whole source.
Rows are dealt once: ranks and the buckets' first ranks meet by the same keys.

Defined results: null text has size 0; a null source is a source of its own and comes last; repeated rows
are separate documents; a source without words has target 0 and is not taken; an empty table gives an
empty result; further columns of the input stay in `resampled`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.rows import BOX, boxed, unboxed
from quillgraph.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that a hash part of the order holds about.
PART_ROWS = 2048
MAX_PARTS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """From (source, source_size), one row a source: its weight and target.

    A target is min(cap * source_size, level * weight); the level is raised until the targets add up to
    share * all sizes. Each round is one aggregation over the sources and fixes at least one more of them.
    """
    # One row a source: the rank decides the weight.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    table = written(sizes.withColumn("weight", weight), "mix-sources")
    most = F.col("source_size") * F.lit(float(cap))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    level, fixed = 0.0, -1
    while True:
        above = most <= F.lit(level) * F.col("weight")
        n, capped, free = table.agg(
            F.count(F.when(above, 1)), F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == fixed or not free:
            break
        fixed, level = n, (total - (capped or 0.0)) / free
    return table.withColumn("target", F.least(most, F.lit(level) * F.col("weight")))


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """boxed docs (of them only the columns keep, where named) with size, source_size, target and copies (how often the
    mix takes the row).

    All documents of a source have one rate, so the running total of expected copies is the rank times the rate."""
    n = docs.count()
    parts = max(1, min(MAX_PARTS, -(-n // PART_ROWS)))
    rows = boxed(docs, doc_id=F.col("doc_id"), source=F.col("source"), size=word_count(F.col("text")))
    if keep is not None:
        rows = rows.withColumn(BOX, F.struct(*[F.col(BOX).getField(c).alias(c) for c in keep]))
    # A source without nulls beside a mark for them: plain keys, by which window and join deal the rows alike.
    rows = rows.withColumns({
        "none": F.col("source").isNull(),
        "own": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "class": F.floor(F.log2(F.col("size") + 1) * 8).cast("int"),
        "part": F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(parts)).cast("int"),
    })
    key = ["class", "part"]
    dealt = ["none", "own", *key]
    buckets = written(rows.groupBy("source", *key).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-buckets")
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap).select(F.col("source").alias("t_source"), "source_size", "target")
    before = Window.partitionBy("source").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        buckets.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("own"), *key, "first", "source_size", "target")
    )
    at = Window.partitionBy(*dealt).orderBy("size", "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (
        rows.withColumn("nth", F.row_number().over(at))
        .join(firsts, dealt)
        .withColumn("nth", F.col("nth") + F.col("first"))
        .withColumn("copies", F.floor(F.col("nth") * rate + offset) - F.floor((F.col("nth") - 1) * rate + offset))
        .select(BOX, "size", "source_size", "target", "copies")
    )


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """The contract of op2: doc_id, size, source_size, target, taken."""
    return mixed(docs.select("doc_id", "text", "source"), keep=("doc_id",), **how).select(
        F.col(BOX).getField("doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def resampled(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus itself: each row of docs as often as the mix takes it, with the columns of docs."""
    out = mixed(docs, **how).where(F.col("copies") > 0)
    return unboxed(out.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))), docs.columns)
