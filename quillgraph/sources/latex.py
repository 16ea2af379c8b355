"""LaTeX sources as relations: main file, included files, sections with their path, captions, metadata.

files: root (one paper), path, text. Headings are cut apart by the JVM's regular expressions and titles carried down by
windows over a paper; only matching braces, which no regular expression does, and following includes are Python.
"""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import join_lines

# Names of a main file, best first; section levels, outer first; float environments.
MAIN = ["main.tex", "paper.tex", "ms.tex", "manuscript.tex"]
LEVELS = ["chapter", "section", "subsection", "subsubsection"]
FLOATS = r"figure\*?|table\*?|longtable|sidewaystable|sidewaysfigure"
MATH = "align|equation|eqnarray|multline|gather"
INCLUDE = re.compile(r"\\(?:input|include)\s*\{([^}]*)\}", re.I)


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)(?<!\\)%.*$", "")


def plain(text: Column) -> Column:
    """Prose without math, footnotes, citations, references and commands; a command's argument stays."""
    x = F.coalesce(text, F.lit(""))
    for math in (rf"(?is)\\begin\{{({MATH})\}}.*?\\end\{{\1\}}", r"(?s)\$\$.*?\$\$", r"(?s)\\\[.*?\\\]", r"\$(?>\\.|[^$\\])+\$"):
        x = F.regexp_replace(x, math, " ")
    x = F.regexp_replace(x, r"(?s)\\footnote\{.*?\}", " ")
    x = F.regexp_replace(x, r"(?i)\\(cite[tp|]?|ref)\*?(\[[^\]]*\])?\{[^{}]*\}", " ")
    for _ in range(3):
        x = F.regexp_replace(x, r"\\[a-zA-Z]+\*?\s*\{([^{}]*)\}", " $1 ")
    x = F.regexp_replace(x, r"\\[a-zA-Z]+\*?(\[[^\]]*\])?", " ")
    return join_lines(F.trim(F.regexp_replace(x, r"[{}~\\\s]+", " ")))


def main_files(files: DataFrame) -> DataFrame:
    """(root, path, text): the known name with a document body, else the shallowest body, else the first file."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    body = F.col("text").contains("\\begin{document}")
    known = F.when(body, F.coalesce(*[F.when(name == n, i) for i, n in enumerate(MAIN)], F.lit(len(MAIN)))).otherwise(len(MAIN) + 1)
    depth = F.when(body & (known == len(MAIN)), F.size(F.split("path", "/"))).otherwise(0)
    best = Window.partitionBy("root").orderBy(known, depth, F.when(known == len(MAIN), name), "path")
    return files.where("text IS NOT NULL").withColumn("k", F.row_number().over(best)).where("k = 1").select("root", "path", "text")


def expanded(files: DataFrame) -> DataFrame:
    """(root, path, text): each paper's main file with all that it includes, each file once; a task holds one paper."""
    key = files.schema["root"].dataType.simpleString()
    chosen = main_files(files).select("root", F.col("path").alias("main"))

    def expand(paper: pd.DataFrame) -> pd.DataFrame:
        texts, seen = dict(zip(paper["path"], paper["text"])), set()

        def follow(text: str, folder: str) -> str:
            def insert(m) -> str:
                name = m.group(1).strip()
                for candidate in ([name + ".tex"] if not name.lower().endswith(".tex") else []) + [name]:
                    path = posixpath.normpath(posixpath.join(folder, candidate))
                    if name and path in texts:
                        if path in seen:
                            return ""
                        seen.add(path)
                        return f"\n{follow(texts[path], posixpath.dirname(path))}\n"
                return ""

            return INCLUDE.sub(insert, text)

        main = paper["main"].iloc[0]
        seen.add(main)
        return pd.DataFrame({"root": [paper["root"].iloc[0]], "path": [main], "text": [follow(texts[main], posixpath.dirname(main))]})

    rows = files.where("text IS NOT NULL").select("root", "path", "text").join(chosen, "root")
    return rows.groupBy("root").applyInPandas(expand, f"root {key}, path string, text string")


def _body(sources: DataFrame) -> DataFrame:
    """sources (root, text) with comments gone and `body` between the marks of the document, if it has them."""
    text = without_comments(F.coalesce("text", F.lit("")))
    inner = F.regexp_extract("tex", r"(?s)\\begin\{document\}(.*?)(?:\\end\{document\}|\z)", 1)
    return sources.select("root", text.alias("tex")).withColumn("body", F.when(F.col("tex").contains("\\begin{document}"), inner).otherwise(F.col("tex")))


def sections(sources: DataFrame) -> DataFrame:
    """(root, pos, level, heading, name, title_path, text): abstract, then sections with text, in order.

    name is the heading of the section above, for subsections. A source without headings is one section Body; an empty
    one has none.
    """
    abstract = r"(?is)\\begin\{abstract\}(.*?)\\end\{abstract\}"
    heading = rf"(?i)\\({'|'.join(LEVELS)})\*?\s*\{{([^{{}}]*)\}}"
    docs = _body(sources).select("root", plain(F.regexp_extract("body", abstract, 1)).alias("abstract"), F.regexp_replace("body", abstract, " ").alias("body"))
    parts = F.split(F.regexp_replace("body", heading, "\u0001$1\u0002$2\u0003"), "\u0001")
    cut = docs.select("root", F.posexplode(parts).alias("pos", "part"), F.size(parts).alias("n"))
    level = F.lower(F.substring_index("part", "\u0002", 1))
    title = plain(F.regexp_extract("part", "(?s)\u0002(.*?)\u0003", 1))
    title = F.when(title == "", F.initcap("level")).when(title == F.upper(title), F.initcap(F.lower(title))).otherwise(title)
    rows = cut.where("pos > 0").withColumn("level", level).select("root", "pos", "level", title.alias("heading"), plain(F.substring_index("part", "\u0003", -1)).alias("text"))
    up = Window.partitionBy("root").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    above = lambda *levels: F.sum(F.when(F.col("level").isin(*levels), 1).otherwise(0)).over(up)
    rows = rows.withColumns({"c": above("chapter"), "s": above("chapter", "section")})
    carried = lambda lev, *part: F.last(F.when(F.col("level") == lev, F.col("heading")), ignorenulls=True).over(
        Window.partitionBy("root", *part).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = rows.withColumns({"sec": carried("section", "c"), "sub": carried("subsection", "s")})
    deep, mid = F.col("level") == "subsubsection", F.col("level") == "subsection"
    path = F.concat_ws(" > ", F.when(mid | deep, F.col("sec")), F.when(deep, F.col("sub")), F.col("heading"))
    name = F.when(deep, F.coalesce("sub", "sec", "heading")).when(mid, F.coalesce("sec", "heading")).otherwise(F.col("heading"))
    found = rows.where("text <> ''").select("root", "pos", "level", "heading", name.alias("name"), path.alias("title_path"), "text")

    def single(frame: DataFrame, word: str, pos: int, text: Column) -> DataFrame:
        one = F.lit(word)
        return frame.select("root", F.lit(pos).alias("pos"), F.lower(one).alias("level"), one.alias("heading"), one.alias("name"), one.alias("title_path"), text.alias("text")).where("text <> ''")

    return single(docs, "Abstract", 0, F.col("abstract")).unionByName(single(cut.where("n = 1"), "Body", 1, plain(F.col("part")))).unionByName(found)


def braced(text: Column) -> Column:
    """What stands between the text's first brace and its match; null if it has none. A backslash hides a brace."""

    def inside(s):
        start = (s or "").find("{")
        depth = 0
        for m in re.finditer(r"\\.|[{}]", s[start:], re.S) if start >= 0 else ():
            depth += {"{": 1, "}": -1}.get(m.group(), 0)
            if not depth:
                return s[start + 1 : start + m.start()]
        return None

    def all_inside(texts: pd.Series) -> pd.Series:
        return texts.map(inside)

    return F.pandas_udf(all_inside, "string")(text)


def captions(sources: DataFrame) -> DataFrame:
    """(root, pos, id, kind, text, graphics): captions of floats, then of \\captionof, in order.

    id is the label, unless an earlier caption has it; else the kind and a number among those so numbered.
    """
    docs = _body(sources).select("root", "body")
    floats = F.regexp_extract_all("body", F.lit(rf"(?is)\\begin\{{({FLOATS})\}}.*?\\end\{{\1\}}"), F.lit(0))
    blocks = docs.select("root", F.posexplode(floats).alias("at", "block")).select("root", F.lit(0).alias("part"), "at", "block", F.regexp_extract("block", r"(?is)\\caption\*?(?:\[[^\]]*\])?\s*(\{.*)", 1).alias("from"))
    loose = F.split("body", r"(?i)\\captionof(?=\{(?:figure|table)\})")
    rest = docs.select("root", F.posexplode(loose).alias("at", "block")).where("at > 0")
    rest = rest.select("root", F.lit(1).alias("part"), "at", "block", F.regexp_extract("block", r"(?s)^\{[^{}]*\}(?:\[[^\]]*\])?\s*(\{.*)", 1).alias("from"))
    rows = blocks.unionByName(rest).withColumn("raw", braced(F.col("from")))
    kind = F.when(F.col("block").rlike(r"(?i)^(\\begin)?\{(sideways)?figure"), "Figure").otherwise("Table")
    after = F.expr("substring(`from`, length(raw) + 2)")
    label = lambda x: F.nullif(F.regexp_extract(x, r"(?i)\\label\{([^{}]+)\}", 1), F.lit(""))
    graphics = F.when(F.col("part") == 0, F.regexp_extract_all("block", F.lit(r"(?i)\\includegraphics(?:\[[^\]]*\])?\s*\{([^{}]+)\}"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    label = F.coalesce(label(after), F.when(F.col("part") == 0, label("block")))
    rows = rows.select("root", "part", "at", kind.alias("kind"), plain(F.col("raw")).alias("text"), label.alias("label"), graphics.alias("graphics")).where("text <> ''")
    order = Window.partitionBy("root").orderBy("part", "at")
    nth = F.row_number().over(Window.partitionBy("root", "label").orderBy("part", "at"))
    rows = rows.withColumns({"pos": F.row_number().over(order), "made": F.when(F.col("label").isNull() | (nth > 1), 1).otherwise(0)})
    number = F.sum("made").over(Window.partitionBy("root", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    name = F.when(F.col("made") == 1, F.concat("kind", number.cast("string"))).otherwise(F.col("label"))
    return rows.select("root", "pos", name.alias("id"), "kind", "text", "graphics")


def metadata(sources: DataFrame) -> DataFrame:
    """(root, title, author, date), null where the source has none."""
    field = lambda name: F.nullif(plain(F.regexp_replace(F.regexp_extract("text", rf"(?is)\\{name}\{{(.*?)\}}", 1), r"\\and\b", ", ")), F.lit(""))
    return sources.select("root", *[field(name).alias(name) for name in ("title", "author", "date")])
