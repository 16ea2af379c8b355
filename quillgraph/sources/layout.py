"""Page layout as relations: sections, title and authors, captions, and the image that a caption belongs to.

Inputs come from whatever reads the pages: lines (doc_id, page, line, text, size, x0, y0, x1, y1) and images
(doc_id, page, image, x0, y0, x1, y1).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X

CAPTION = r"^\s*(Fig(?:ure|\.)?|Tab(?:le|\.)?)\s*\.?\s*([0-9]+|[IVXLC]+)\s*[.:|-]?\s*(.*)$"
#: A caption's image ends at most this far below the caption's top; one beside it is at most this far above.
BELOW, BESIDE = 10.0, 200.0


def sections(rows: DataFrame, key: str, order: list[str], is_head: Column, page: str = "page") -> DataFrame:
    """(key, section, heading, text, page_start, page_end): lines joined under the heading above them.

    A section's number is the running count of headings; lines before the first are section 0 with heading Body. Text
    is put together by one aggregation of a document's section, whose size is that of its lines.
    """
    up = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("head", is_head).withColumns({"section": F.sum(F.col("head").cast("int")).over(up), "nth": F.row_number().over(Window.partitionBy(key).orderBy(*order))})
    lines = F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("nth", "text"))))
    return marked.groupBy(key, "section").agg(
        F.coalesce(F.max(F.when(F.col("head"), F.col("text"))), F.lit("Body")).alias("heading"),
        F.array_join(F.transform(lines, lambda x: x["text"]), " ").alias("text"),
        F.min(page).alias("page_start"), F.max(page).alias("page_end"),
    )


def title_and_authors(lines: DataFrame) -> DataFrame:
    """(doc_id, title, authors) from the first page: the largest type is the title, the largest below it the authors."""
    first = lines.where("page = 0 AND trim(text) <> ''")
    doc = Window.partitionBy("doc_id")
    big = first.withColumn("most", F.max("size").over(doc)).withColumn("large", F.col("size") >= F.col("most") - 0.5)
    big = big.withColumn("top", F.min(F.when(F.col("large"), F.col("y0"))).over(doc))
    big = big.withColumn("is_title", F.col("large") & (F.col("y0") < F.col("top") + 300))
    below = (F.col("y0") > F.col("top")) & ~F.col("is_title")
    big = big.withColumn("next", F.max(F.when(below, F.col("size"))).over(doc)).withColumn("is_author", below & (F.abs(F.col("size") - F.col("next")) <= 0.6))
    joined = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("y0", "x0", F.trim("text").alias("t"))))), lambda x: x["t"]), " ")
    return big.groupBy("doc_id").agg(joined(F.col("is_title")).alias("title"), joined(F.col("is_author")).alias("authors"))


def captions(lines: DataFrame) -> DataFrame:
    """Lines that open with a figure or table mark, with kind, number, id and body; one row for each (id, text, page)."""
    part = lambda i: F.regexp_extract("text", "(?i)" + CAPTION, i)
    rows = lines.where(F.col("text").rlike("(?i)" + CAPTION)).withColumns({"kind": F.when(F.lower(part(1)).startswith("fig"), "Figure").otherwise("Table"), "number": F.upper(part(2)), "body": part(3)})
    return rows.withColumn("id", F.concat("kind", "number")).dropDuplicates(["doc_id", "id", "body", "page"])


def caption_images(found: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, line, image): each caption in turn takes the nearest free image above it, at most one; null if none fits.

    Images of a page are few and meet in one task; a page is the largest group.
    """
    key = found.schema["doc_id"].dataType.simpleString()
    box = ["x0", "y0", "x1", "y1"]
    image = "image" if "image" in images.columns else "line"
    union = found.select("doc_id", "page", "line", F.lit(None).cast("int").alias("image"), *box).unionByName(images.select("doc_id", "page", F.lit(None).cast("int").alias("line"), F.col(image).cast("int").alias("image"), *box))

    def take(page: pd.DataFrame) -> pd.DataFrame:
        free = {int(r.image): r for r in page[page["image"].notna()].sort_values("image").itertuples()}
        out = []
        for c in page[page["line"].notna()].sort_values("line").itertuples():
            gaps = []
            for i, im in free.items():
                gap = max(0.0, c.y0 - im.y1)
                beside = im.x1 < c.x0 or im.x0 > c.x1
                if im.y1 <= c.y0 + BELOW and not (beside and gap > BESIDE):
                    gaps.append((gap, i))
            got = min(gaps)[1] if gaps else None
            free.pop(got, None)
            out.append((c.doc_id, c.page, int(c.line), got))
        frame = pd.DataFrame(out, columns=["doc_id", "page", "line", "image"])
        return frame.astype({"image": "Int32"})

    return union.groupBy("doc_id", "page").applyInPandas(take, f"doc_id {key}, page int, line int, image int")


def is_heading(text: Column) -> Column:
    """A short line that opens with a number or is a known section name."""
    short = (F.length(F.trim(text)) <= 80) & ~F.trim(text).endswith(".")
    return short & (text.rlike(r"^\s*[0-9]+(\.[0-9]+)*\.?\s+\p{Lu}") | (X.head_hint(text) != "OTHER") | F.lower(F.trim(text)).isin("abstract", "acknowledgements", "appendix"))
