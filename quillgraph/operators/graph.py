"""Graph clean-up: dedup, remap, relation check, coherence, backbone, layout, views and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.plans import dims


def node_dedup(nodes: DataFrame) -> DataFrame:
    """Every node with kept (the node that stands for its text), merged and polarity of the group."""
    context = F.when(F.col("type") == "Hypothesis", F.when(F.col("section").contains("INTRO"), "INTRO").when(F.col("section").contains("DISCUSSION"), "DISCUSSION").otherwise("OTHER")).otherwise("")
    keyed = nodes.withColumns({"norm": X.norm_text(F.col("text")), "context": context})
    key = ["doc_id", "type", "norm", "context"]
    best = Window.partitionBy(*key).orderBy(F.desc("conf"), "node_idx")
    whole = Window.partitionBy(*key)
    return keyed.select(
        "doc_id", "node_idx", "sent_idx", "page", "section", "text", "type", "conf", F.first("node_idx").over(best).alias("kept"), F.count("*").over(whole).alias("merged"),
        F.when(F.min("polarity").over(whole) != F.max("polarity").over(whole), "neutral").otherwise(F.col("polarity")).alias("polarity"),
    )


def kept_nodes(dedup: DataFrame) -> DataFrame:
    return dedup.where("kept = node_idx").drop("kept")


def remapped(edges: DataFrame, dedup: DataFrame) -> DataFrame:
    """Edges between the kept nodes, with the ends' types and polarity."""
    ends = dedup.select("doc_id", F.col("node_idx").alias("n"), F.col("kept"), F.col("type").alias("t"), F.col("polarity").alias("p"))
    a = ends.select("doc_id", F.col("n").alias("src"), F.col("kept").alias("ksrc"), F.col("t").alias("st"), F.col("p").alias("sp"))
    b = ends.select("doc_id", F.col("n").alias("dst"), F.col("kept").alias("kdst"), F.col("t").alias("dt"), F.col("p").alias("dp"))
    return edges.join(a, ["doc_id", "src"]).join(b, ["doc_id", "dst"]).select("doc_id", F.col("ksrc").alias("src"), F.col("kdst").alias("dst"), "type", "conf", "hint", "pos", "st", "dt", "sp", "dp")


def relinked(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Edges of allowed type pairs; a relation that the pair does not allow becomes its default, if that is allowed."""
    rows = [(a, b, kinds, default) for (a, b), (kinds, default) in dims.ALLOWED.items()]
    allowed = F.broadcast(spark.createDataFrame(rows, "st string, dt string, kinds array<string>, default string"))  # one row a pair
    default = F.when((F.col("st") == "Result") & (F.col("dt") == "Hypothesis") & ((F.col("sp") == "negative") | (F.col("dp") == "negative")), "refutes").otherwise(F.col("default"))
    joined = edges.join(allowed, ["st", "dt"]).withColumn("fallback", default)
    ok = F.expr("array_contains(kinds, type)")
    hint = F.when(ok, F.col("hint")).otherwise(F.concat("hint", F.lit(";retyped")))
    return joined.where(ok | F.expr("array_contains(kinds, fallback)")).select("doc_id", "src", "dst", F.when(ok, F.col("type")).otherwise(F.col("fallback")).alias("type"), "conf", hint.alias("hint"), "pos", "st", "dt")


def edge_dedup(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target, type): the most confident, of equal ones the first."""
    best = F.min(F.struct((-F.col("conf")).alias("c"), "pos", "hint"))
    found = edges.groupBy("doc_id", "src", "dst", "type").agg(best.alias("b"), F.min("pos").alias("pos"))
    return found.select("doc_id", "src", "dst", "type", (-F.col("b.c")).alias("conf"), F.col("b.hint").alias("hint"), "pos")


def with_backbone(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges, and the backbone of the documents that have none."""
    last = F.struct(F.lit(9).alias("a"), F.col("src").alias("b"), F.col("dst").alias("c"), F.lit(0).alias("d"), F.lit("").alias("e"))
    return edges.unionByName(backbone(spark, nodes, edges).withColumn("pos", last))


def coherence(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, nodes, touched, coherence, hypotheses, results, needs_llm)."""
    ends = edges.select("doc_id", F.explode(F.array("src", "dst")).alias("n")).distinct().groupBy("doc_id").agg(F.count("*").alias("touched"))
    count = lambda t: F.count(F.when(F.col("type") == t, 1))
    per = nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), count("Hypothesis").alias("hypotheses"), count("Result").alias("results"))
    out = per.join(ends, "doc_id", "left").withColumn("touched", F.coalesce("touched", F.lit(0)))
    out = out.withColumn("coherence", F.col("touched").cast("double") / F.col("nodes"))
    return out.withColumn("needs_llm", (F.col("results") < 1) | (F.col("hypotheses") < 1) | (F.col("coherence") < 0.6))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select("doc_id", F.explode(F.array("src", "dst")).alias("node_idx")).groupBy("doc_id", "node_idx").agg(F.count("*").alias("degree"))


def backbone(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For documents without an edge: links of the first two nodes of each type of the five standard pairs."""
    first = Window.partitionBy("doc_id", "type").orderBy("node_idx")
    few = nodes.join(edges.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("k", F.row_number().over(first)).where("k <= 2")
    specs = F.broadcast(spark.createDataFrame(dims.BACKBONE, "st string, dt string, etype string"))
    a = few.select("doc_id", F.col("node_idx").alias("src"), F.col("type").alias("st"), F.col("polarity").alias("sp"))
    b = few.select("doc_id", F.col("node_idx").alias("dst"), F.col("type").alias("dt"))
    kind = F.when((F.col("etype") == "supports") & (F.col("sp") == "negative"), "refutes").otherwise(F.col("etype"))
    return a.join(specs, "st").join(b, ["doc_id", "dt"]).select("doc_id", "src", "dst", kind.alias("type"), F.lit(0.56).alias("conf"), F.lit("fallback").alias("hint"))


def layout(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_idx, col, row, x, y): a column for each type, rows by page, sentence, height on the page (y0, if
    there) and number; what has none of them, or a negative one, comes last."""
    col = dims.lookup({t: i for i, t in enumerate(dims.TYPES)}, F.col("type"), default=8)
    order = Window.partitionBy("doc_id", "type").orderBy(*[F.when(F.col(c) >= 0, F.col(c)).asc_nulls_last() for c in ("page", "sent_idx", "y0") if c in nodes.columns], "node_idx")
    out = nodes.select("doc_id", "node_idx", col.alias("col"), (F.row_number().over(order) - 1).alias("row"))
    return out.withColumns({"x": F.col("col") * 320 + 120, "y": F.col("row") * 100 + 250})


def payload(nodes: DataFrame) -> DataFrame:
    """The most confident nodes of each type, with shortened text, for a language model."""
    order = Window.partitionBy("doc_id", "type").orderBy(F.desc("conf"), "node_idx")
    rows = nodes.withColumn("k", F.row_number().over(order)).where(F.col("k") <= dims.lookup(dims.PAYLOAD, F.col("type"), default=0))
    return rows.select("doc_id", "node_idx", "type", "k", X.soft_cut(F.col("text")).alias("text"))


def fan_out(edges: DataFrame, most: int = 3) -> DataFrame:
    """The first edges of each source that a view shows, in the order of the edges (pos)."""
    order = Window.partitionBy("doc_id", "src").orderBy("pos", "dst", "type")
    return edges.where(F.col("conf") >= dims.GRAPH_MIN).withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("doc_id", "src", "dst", "type", "k")


def merged_runs(items: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """Neighbours of one kind joined in pairs: (1+2), (3+4), ..."""
    w = Window.partitionBy(key).orderBy(order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.lag(kind).over(w) == F.col(kind), 0).otherwise(1)
    rows = items.withColumn("new", new).withColumn("island", F.sum("new").over(up))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(key, "island").orderBy(order)))
    pair = F.floor((F.col("nth") - 1) / 2).alias("pair")
    return rows.groupBy(key, "island", pair, kind).agg(F.min(order).alias("first"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes by document and type with totals: one pass for both (doc_id null: all documents)."""
    per = nodes.rollup("type", "doc_id").agg(F.count("*").alias("nodes"), F.round(F.avg("conf"), 6).alias("mean_conf")).where("type is not null")
    return per.select("type", "doc_id", "nodes", "mean_conf")


def quality(nodes: DataFrame, edges: DataFrame, checked: DataFrame) -> DataFrame:
    """Q = .35 types present + .25 confident nodes + .25 coherence + .15 edges a node; bands green, yellow, red."""
    per = nodes.groupBy("doc_id").agg(F.countDistinct("type").alias("types"), F.avg(F.when(F.col("conf") >= 0.6, 1.0).otherwise(0.0)).alias("sure"), F.count("*").alias("nodes"))
    links = edges.groupBy("doc_id").agg(F.count("*").alias("edges"))
    c = coherence(nodes, checked).select("doc_id", "coherence")
    q = F.col("types") / 8.0 * 0.35 + F.col("sure") * 0.25 + F.col("coherence") * 0.25 + F.least(F.lit(1.0), F.coalesce("edges", F.lit(0)) / F.col("nodes")) * 0.15
    out = per.join(c, "doc_id").join(links, "doc_id", "left").select("doc_id", F.round(q, 6).alias("q"))
    return out.withColumn("band", F.when(F.col("q") >= 0.75, "green").when(F.col("q") >= 0.6, "yellow").otherwise("red"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """(doc_id, first, n, type, section, page, text, conf): nodes that follow each other in sentences, of one type, section
    and page, joined in pairs; text with a space between, conf their mean."""
    w = Window.partitionBy("doc_id").orderBy("node_idx")
    same = [F.lag(c).over(w) == F.col(c) for c in ("type", "section", "page")]
    goes_on = same[0] & same[1] & same[2] & (F.col("sent_idx") - F.lag("sent_idx").over(w) <= 1)
    rows = nodes.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("pair", F.floor((F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("node_idx")) - 1) / 2))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_idx", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("doc_id", "island", "pair").agg(
        F.min("node_idx").alias("first"), F.count("*").alias("n"), F.first("type").alias("type"), F.first("section").alias("section"), F.first("page").alias("page"), texts.alias("text"), F.round(F.avg("conf"), 3).alias("conf")
    ).drop("island", "pair")


def tallies(nodes: DataFrame, edges: DataFrame, hits: DataFrame, sections: DataFrame, most_rules: int = 200) -> DataFrame:
    """(doc_id, sections, nodes, edges, rules): how many of each by name, as sorted arrays; at most `most_rules` rules, which
    reports are cut to."""

    def counted(df: DataFrame, by: str, name: str, n=None) -> DataFrame:
        per = df.groupBy("doc_id", F.col(by).alias("name")).agg((F.sum(n) if n else F.count("*")).alias("n"))
        return per.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("name", "n"))).alias(name))

    out = counted(sections, "section", "sections").join(counted(nodes, "type", "nodes"), "doc_id", "left").join(counted(edges, "type", "edges"), "doc_id", "left")
    out = out.join(counted(hits, "rule", "rules", "hits"), "doc_id", "left")
    return out.withColumn("rules", F.slice("rules", 1, most_rules))


def report_json(report: DataFrame) -> DataFrame:
    return report.select("doc_id", F.to_json(F.struct("doc_id", "sections", "nodes", "edges", "rules")).alias("report"))


def _lines(column: str, title: str, item) -> tuple[Column, Column]:
    total = F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0))
    rows = F.coalesce(F.array_join(F.transform(column, item), ""), F.lit(""))
    return F.format_string(title, total), rows


PARTS = [("sections", "sentences"), ("nodes", "nodes"), ("edges", "edges"), ("rules", "rule hits")]


def report_markdown(report: DataFrame) -> DataFrame:
    """(doc_id, report): a heading, and a list with its total for each tally."""
    parts = [F.format_string("# Report: %s\n", F.col("doc_id").cast("string"))]
    for column, word in PARTS:
        parts += _lines(column, f"\n## {word}: %d\n", lambda x: F.concat(F.lit("- "), x["name"], F.lit(": "), x["n"].cast("string"), F.lit("\n")))
    return report.select("doc_id", F.concat(*parts).alias("report"))


def report_html(report: DataFrame) -> DataFrame:
    parts = [F.format_string("<h1>Report: %s</h1>", F.col("doc_id").cast("string"))]
    for column, word in PARTS:
        head, rows = _lines(column, f"<h2>{word}: %d</h2><ul>", lambda x: F.concat(F.lit("<li>"), F.replace(F.replace(x["name"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(": "), x["n"].cast("string"), F.lit("</li>")))
        parts += [head, rows, F.lit("</ul>")]
    return report.select("doc_id", F.concat(*parts).alias("report"))
