"""TEI files as flat sentences with pages, boxes, sections and citation flags, and their metadata.

The XML is walked once a file for its elements in document order; everything else is columns over them. A file that
does not parse gives one row with its error and no sentences.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X

ELEMENT = "path string, pos int, tag string, text string, coords string, parent_coords string, in_abstract boolean, has_ref boolean, error string"
HEADER = "path string, title string, author string, created string, arxiv_id string, error string"
SPACES = "^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$"
# Citations in running text (numbers in brackets; author and year), and brackets that are none.
BRACKETS = r"(?<![A-Za-z])\[\s*[0-9]{1,3}(?:\s*[-–,;]\s*[0-9]{1,3}){0,6}\]"
AUTHOR_YEAR = r"\(\s*[A-Z][A-Za-z'’-]+(?:\s+et\s+al\.)?(?:\s*,\s*((?:18|19|20|21)[0-9]{2}))(?:\s*[,;]\s*[A-Z][A-Za-z'’-]+(?:\s+et\s+al\.)?\s*,\s*((?:18|19|20|21)[0-9]{2}))*\s*\)"
NO_CITATION = r"(?i)\([^)]{0,6}(?:n\s*=\s*[0-9]+|p\s*[<≤=]\s*0?\.[0-9]+|CI\s*[0-9]{1,3}\s*%|Fig\.?\s*[0-9]+|Table\s*[0-9]+|Eq\.?\s*[0-9]+)[^)]{0,20}\)"
FIRST_YEAR, FLAT_HEAD = 1800, 12.0


def _local(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _text(node) -> str:
    return "".join(node.itertext())


def _own_boxes(node, parent) -> tuple[str | None, str | None]:
    """Coordinates of an element and of what holds it: a caption's figure; a table's head and the table itself."""
    if _local(node) == "table":
        head = next((c for c in node if _local(c) == "head"), None)
        return (head.get("coords") if head is not None else None), node.get("coords")
    figure = parent is not None and _local(parent).lower() == "figure"
    return node.get("coords"), parent.get("coords") if figure and _local(node) == "figDesc" else None


def elements(files: DataFrame) -> DataFrame:
    """files (path, tei): heads, sentences, figure captions and tables with a head, in document order."""

    def rows_of(path: str, tei: str):
        pos, stack = 0, [(ET.fromstring(tei), None, False)]
        while stack:
            node, parent, abstract = stack.pop()
            tag = _local(node)
            abstract = abstract or tag.lower() == "abstract" or (tag.lower() == "div" and (node.get("type") or "").lower() in ("abstract", "summary"))
            read = next((c for c in node if _local(c) == "head"), None) if tag == "table" else node
            if tag in ("head", "s", "figDesc", "table") and read is not None:
                refs = any((r.get("type") or "").lower().startswith("bibl") or (r.get("target") or "").startswith("#b") for r in read.iter("ref"))
                yield path, pos, tag, _text(read), *_own_boxes(node, parent), abstract, refs, None
                pos += 1
            stack += [(child, node, abstract) for child in reversed(node)]

    def parse(frames):
        for frame in frames:
            out = []
            for path, tei in zip(frame["path"], frame["tei"]):
                try:
                    out += list(rows_of(path, tei or ""))
                except ET.ParseError as e:
                    out.append((path, 0, None, None, None, None, False, False, str(e)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ELEMENT.split(", ")])

    return files.select(F.col("path").cast("string").alias("path"), "tei").mapInPandas(parse, ELEMENT)


def citation_strength(text: Column, has_ref: Column, last_year: int) -> Column:
    """A marked reference, else author and year of a possible year, else numbers in brackets."""
    years = [F.regexp_extract(text, AUTHOR_YEAR, i) for i in (1, 2)]
    fits = ~text.rlike(NO_CITATION) & text.rlike(AUTHOR_YEAR)
    for y in years:
        fits = fits & ((y == "") | y.cast("int").between(FIRST_YEAR, last_year))
    return F.when(has_ref, 1.0).when(fits, 0.7).when(text.rlike(BRACKETS), 0.5).otherwise(0.0)


def sentences(found: DataFrame, last_year: int, drop_flat_heads: bool = False) -> DataFrame:
    """Elements to (path, sent_idx, text, page, x0, y0, x1, y1, section, is_caption, caption_type, has_citation,
    citation_strength). A telling head holds for what follows; sentences of an abstract are of the abstract.

    drop_flat_heads: heads of introduction and references less than FLAT_HEAD high, as running titles are, tell nothing.
    """
    own, parent = X.boxes(F.col("coords")), X.boxes(F.col("parent_coords"))
    rows = found.where("error is null").withColumns({"box": X.union_box(F.concat(own, parent)), "text": X.normalize_inline(F.regexp_replace("text", SPACES, ""))})
    hint = X.head_hint(F.col("text"))
    flat = hint.isin("INTRO", "REFERENCES") & (F.col("box.y1") - F.col("box.y0") < FLAT_HEAD)
    tells = (F.col("tag") == "head") & (hint != "OTHER")
    if drop_flat_heads:
        tells = tells & ~flat
    up = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last(F.when(tells, hint), ignorenulls=True).over(up), F.lit("OTHER"))).where("tag <> 'head' and text <> ''")
    kind = F.when(F.col("tag") == "figDesc", "Figure").when(F.col("tag") == "table", "Table").otherwise("")
    rows = rows.withColumn("citation_strength", citation_strength(F.col("text"), F.col("has_ref"), last_year))
    order = Window.partitionBy("path").orderBy("pos")
    return rows.select(
        "path", (F.row_number().over(order) - 1).alias("sent_idx"), "text", F.coalesce(F.col("box.page") - 1, F.lit(0)).alias("page"), *[F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")],
        F.when((F.col("tag") == "s") & F.col("in_abstract"), "ABSTRACT").otherwise(F.col("section")).alias("section"), (kind != "").alias("is_caption"), kind.alias("caption_type"),
        (F.col("citation_strength") > 0).alias("has_citation"), "citation_strength",
    )


def metadata(files: DataFrame) -> DataFrame:
    """files (path, tei): title, authors, date and arXiv id of the header."""

    def read(tei: str) -> tuple:
        root = ET.fromstring(tei)
        every = lambda *names: [n for n in root.iter() if _local(n) in names]
        within = lambda *path: _under([root], path)
        text = lambda nodes: next((_text(n).strip() for n in nodes), "")
        title = text(within("teiHeader", "fileDesc", "titleStmt", "title"))
        authors = []
        for a in within("teiHeader", "fileDesc", "titleStmt", "author"):
            name = next((n for n in a.iter() if _local(n) == "persName"), a)
            authors.append(_text(name).strip() or _text(a).strip())
        date = text(within("teiHeader", "fileDesc", "publicationStmt", "date")) or text(within("teiHeader", "date"))
        ids = [_text(n).strip() for n in every("idno") if "arXiv" in n.get("type", "") + _text(n)]
        links = [n.get("target") or n.get("{http://www.w3.org/1999/xlink}href") or "" for n in every("ptr", "ref")]
        return title, ", ".join(a for a in authors if a), date, next(filter(None, ids), None), [x for x in links if "arxiv.org" in x]

    def parse(frames):
        for frame in frames:
            out = []
            for path, tei in zip(frame["path"], frame["tei"]):
                try:
                    *fields, links = read(tei or "")
                    out.append((path, *fields, links, None))
                except ET.ParseError as e:
                    out.append((path, None, None, None, None, [], str(e)))
            yield pd.DataFrame(out, columns=["path", "title", "author", "created", "arxiv_id", "links", "error"])

    rows = files.select(F.col("path").cast("string").alias("path"), "tei").mapInPandas(parse, HEADER.replace("error", "links array<string>, error"))
    number = F.transform("links", lambda x: F.regexp_extract(x, r"[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?", 0))
    linked = F.get(F.filter(number, lambda x: x != ""), F.lit(0))
    return rows.withColumn("arxiv_id", F.coalesce("arxiv_id", linked, F.when(F.col("error").isNull(), ""))).drop("links")


def _under(nodes, path):
    """Descendants by names: each step may skip levels."""
    for name in path:
        nodes = [x for n in nodes for x in n.iter() if _local(x) == name and x is not n]
    return nodes


def documents(files: DataFrame, last_year: int) -> tuple[DataFrame, DataFrame]:
    """(documents, sentences) of files (path, tei): a document's id is its arXiv id, else its file's cleaned stem;
    page_count is its last page. Broken files are documents with an error."""
    meta = metadata(files)
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", ""), "[^a-zA-Z0-9._-]+", "-")
    meta = meta.withColumn("doc_id", F.coalesce(F.nullif("arxiv_id", F.lit("")), stem))
    found = sentences(elements(files), last_year)
    pages = found.groupBy("path").agg((F.max("page") + 1).alias("page_count"))
    docs = meta.join(pages, "path", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    return docs, found.join(meta.select("path", "doc_id"), "path")
