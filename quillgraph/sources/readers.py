"""Sources: documents, pages, TEI and status events as relations; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X

SECTION = (
    "CASE WHEN 100 * sent_idx < 10 * n THEN 'ABSTRACT' WHEN 100 * sent_idx < 25 * n THEN 'INTRO' WHEN 100 * sent_idx < 50 * n THEN 'METHODS' "
    "WHEN 100 * sent_idx < 75 * n THEN 'RESULTS' WHEN 100 * sent_idx < 90 * n THEN 'DISCUSSION' ELSE 'REFERENCES' END"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores where their files have fewer splits than that, as one small file has; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, n, text, page, section): sentences in order, empty ones dropped; sections by position."""
    parts = F.filter(F.split(F.regexp_replace("text", "([.!?])[ \t\n\r]+", "$1\n"), "\n"), lambda x: F.trim(x) != "")
    # outer: an inner explode infers a filter on the parts, which is pushed down and splits every text a second time.
    rows = docs.select("doc_id", parts.alias("parts")).select("doc_id", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("sent_idx", "text")).where("sent_idx is not null")
    return rows.withColumns({"page": F.expr("sent_idx div 20").cast("int"), "section": F.expr(SECTION)}).select("doc_id", "sent_idx", "n", "text", "page", "section")


def page_elements(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, text) of headings and paragraphs in order."""
    hits = F.regexp_extract_all("html", F.lit(r"<(?:h1|p)>[^<]*"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(hits).alias("pos", "hit"))
    return rows.select("page_id", "pos", F.when(F.col("hit").startswith("<h1>"), "head").otherwise("s").alias("tag"), F.regexp_replace("hit", r"^<(h1|p)>", "").alias("text"))


def carried_sections(elements: DataFrame) -> DataFrame:
    """The hint of the last telling head above each sentence."""
    hint = F.when(F.col("tag") == "head", F.nullif(X.head_hint(F.col("text")), F.lit("OTHER")))
    up = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return elements.withColumn("hint", F.coalesce(F.last(hint, ignorenulls=True).over(up), F.lit("OTHER"))).where("tag = 's'").select("page_id", "pos", "hint")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def top_per_label(nodes: DataFrame, most: int = 12) -> DataFrame:
    """The rows of the markdown summary: the most confident nodes of each label."""
    order = Window.partitionBy("type").orderBy(F.desc("conf"), "doc_id", "sent_idx")
    return nodes.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("type", "nth", "doc_id", "sent_idx", "conf")


def write_markdown(nodes: DataFrame, path: str) -> None:
    line = F.format_string("- **%s** %.3f %s:%d", "type", "conf", F.col("doc_id").cast("string"), F.col("sent_idx"))
    top_per_label(nodes).orderBy("type", "nth").select(line.alias("value")).write.mode("overwrite").text(path)
