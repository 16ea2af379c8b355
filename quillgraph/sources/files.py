"""File listings, the years that a collection covers, rule registries, and lookups that stay inside their folder."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, root: str, suffix: str = ".pdf", most: int = 2000) -> DataFrame:
    """(path, length, total): the first `most` files below root, by path, and how many there are. Contents stay unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root).select("path", "length")
    return found.orderBy("path").limit(most).crossJoin(found.agg(F.count("*").alias("total")))  # one row beside


def covered_years(files: DataFrame) -> DataFrame:
    """files (category, name): (category, year) that a file was picked for: its target in TARGET--PICKED__title, else
    the year before the title."""
    target = F.regexp_extract("name", r"^([0-9]{4})(?:--[0-9]{4})?__.+\.(?:pdf|PDF)$", 1)
    return files.select("category", target.alias("year")).where("year <> ''").select("category", F.col("year").cast("int").alias("year")).distinct()


def missing_years(files: DataFrame, wanted: list[int]) -> DataFrame:
    """(category, year): wanted years that no file of a category covers; categories with as many files as years miss none."""
    short = files.groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") < len(wanted))
    years = short.select("category", F.explode(F.array(*[F.lit(y) for y in wanted])).alias("year"))
    return years.join(covered_years(files), ["category", "year"], "left_anti")


def year_candidates(year: Column, radius: int = 2) -> Column:
    """The year, then its neighbours, the earlier one first."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda d: F.when(d == 0, F.array(year)).otherwise(F.array(year - d, year + d))))


def inside(root: str, path: str) -> str | None:
    """root/path, or None where it would lead out of root."""
    top = posixpath.normpath(root)
    full = posixpath.normpath(posixpath.join(top, path))
    return full if full == top or full.startswith(top.rstrip("/") + "/") else None


def registry(spark: SparkSession, root: str, name: str = "triggers.json") -> dict[str, dict]:
    """Theme to its triggers, of the folders below root; a file that is no JSON object counts as empty. Packs are small
    and live on the driver."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("path")).collect()
    out = {}
    for value, path in sorted((r["value"], r["path"]) for r in rows):
        try:
            data = json.loads(value)
        except ValueError:
            data = {}
        out[path.split("/")[-2]] = data if isinstance(data, dict) else {}
    return dict(sorted(out.items()))


def merged_packs(packs: dict[str, list[dict]], themes: list[str]) -> list[dict]:
    """The rules of common and of the wanted themes; a later rule of the same name replaces an earlier one."""
    rules = {rule["name"]: rule for theme in dict.fromkeys(["common", *themes]) for rule in packs.get(theme, [])}
    return list(rules.values())


def preview(text: Column, most: int = 50_000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("\n... [truncated]"))).otherwise(text)


def write_by_document(df: DataFrame, path: str, kind: str = "json") -> None:
    """An artifact of a corpus, in one folder a document, so that a look-up reads one."""
    df.write.mode("overwrite").partitionBy("doc_id").format(kind).save(path)


def of_document(spark: SparkSession, path: str, doc_id, schema, kind: str = "json") -> DataFrame:
    """What write_by_document wrote of one document."""
    return spark.read.schema(schema).format(kind).load(path).where(F.col("doc_id") == F.lit(doc_id))
