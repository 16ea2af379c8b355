"""Links between nodes: banded proximity, long range, references, and confidence reinforcement.

Links are found on narrow rows (document, node, sentence, page, section, type); what a node's text says is worked out
once a node, and joined to the links that are left.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillgraph.functions import text as X
from quillgraph.plans import dims

#: Sentences in a bucket of the band join; no less than the widest band.
BAND = 32
SPEC = "st string, dt string, etype string, ord int, max_forward int, max_k int, max_page int, min_conf double, bonus double"
LONG_SPEC = "st string, dt string, etype string, from_secs array<string>, to_secs array<string>, bonus double, min_conf double, per_src int, ord int"
PLACE = ["doc_id", "node_idx", "sent_idx", "page", "section", "type"]
SAYS = ["conf", "polarity", "tok", "ref", "numeric", "cue", "method", "shown"]


def features(nodes: DataFrame) -> DataFrame:
    """Nodes with what links ask of their text: words, figure and table marks, numbers and signs."""
    low = F.lower("text")
    has = lambda *words: F.greatest(*[low.contains(w) for w in words])
    text = F.col("text")
    return nodes.select(
        *PLACE, "conf", "polarity", X.edge_tokens(text).alias("tok"), X.references(text).alias("ref"), X.has_numeric(text).alias("numeric"),
        has(*dims.CUES).alias("cue"), has("method", "protocol").alias("method"), has("table", "figure").alias("shown"),
    )


def _side(nodes: DataFrame, p: str, columns: list[str]) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{p}_{c}") for c in columns])


def _said(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a_doc_id, a_node_idx, b_node_idx) with what both ends say."""
    for p in "ab":
        own = nodes.select(F.col("doc_id").alias("f_doc"), F.col("node_idx").alias("f_node"), *[F.col(c).alias(f"{p}_{c}") for c in SAYS])
        pairs = pairs.join(own, (F.col("a_doc_id") == F.col("f_doc")) & (F.col(f"{p}_node_idx") == F.col("f_node"))).drop("f_doc", "f_node")
    return pairs


def _imrad_allowed() -> Column:
    """Direction by target section; the reference section links nothing."""
    a, b = F.col("a_type"), F.col("b_type")
    source, target = X.imrad_norm(F.col("a_section")), X.imrad_norm(F.col("b_section"))
    late = target.isin("RESULTS", "DISCUSSION", "CONCLUSION")
    return (source != "REFERENCES") & (target != "REFERENCES") & (
        F.when((a == "Experiment") & b.isin("Result", "Analysis", "Conclusion"), late)
        .when((a == "Result") & b.isin("Result", "Conclusion", "Hypothesis"), late)
        .when(a.isin("Technique", "Dataset") & b.isin("Experiment", "Analysis"), target.isin("METHODS", "RESULTS", "DISCUSSION"))
        .when((a == "Input Fact") & b.isin("Hypothesis", "Experiment", "Result", "Conclusion"), late | (target == "METHODS"))
        .otherwise(True)
    )


def proximity_candidates(spark: SparkSession, nodes: DataFrame, by_section: bool = True) -> DataFrame:
    """The nearest max_k targets of each source and link kind, within its band of sentences and pages.

    A band never reaches over more than one bucket border, so sources go to two buckets and targets to one: the
    join stays an equi-join however long a document is. nodes: features. by_section: the direction rule looks at the
    sections.
    """
    specs = F.broadcast(spark.createDataFrame(dims.PROXIMITY, SPEC))  # one row a link kind
    at = F.floor(F.col("a_sent_idx") / BAND)
    a = _side(nodes, "a", PLACE).withColumn("bucket", F.explode(F.array(at, at + 1)))
    b = _side(nodes, "b", PLACE).withColumn("b_bucket", F.floor(F.col("b_sent_idx") / BAND))
    gap, pages = F.col("b_sent_idx") - F.col("a_sent_idx"), F.abs(F.col("b_page") - F.col("a_page"))
    pairs = (
        a.join(specs, F.col("a_type") == F.col("st"))
        .join(b, (F.col("a_doc_id") == F.col("b_doc_id")) & (F.col("bucket") == F.col("b_bucket")) & (F.col("b_type") == F.col("dt")) & (gap > 0) & (gap <= F.col("max_forward")) & (pages <= F.col("max_page")))
        .withColumns({"gap": gap, "pages": pages})
    )
    if by_section:
        pairs = pairs.where(_imrad_allowed())
    nearest = Window.partitionBy("a_doc_id", "ord", "a_node_idx").orderBy("gap", "b_node_idx")
    kept = pairs.withColumn("k", F.row_number().over(nearest)).where(F.col("k") <= F.col("max_k"))
    kept = kept.select("a_doc_id", "a_node_idx", "b_node_idx", "a_section", "b_section", "st", "dt", "etype", "ord", "min_conf", "bonus", "gap", "pages")
    said = _said(kept, nodes)
    least = F.greatest(threshold(F.col("gap"), F.col("pages")), F.col("min_conf"))
    kind = F.when((F.col("ord") == 4) & (F.col("a_polarity") == "negative"), "refutes").otherwise(F.col("etype"))
    return said.select(
        F.col("a_doc_id").alias("doc_id"), F.col("a_node_idx").alias("src"), F.col("b_node_idx").alias("dst"), "ord", "gap",
        F.col("a_conf").alias("ca"), F.col("b_conf").alias("cb"), (adjustment() + F.col("bonus")).alias("extra"), least.alias("least"), kind.alias("type"),
    )


def adjustment() -> Column:
    """What shared words and references, and the pair's own signs, add to a link's confidence."""
    shared = F.size(F.array_intersect("a_tok", "b_tok"))
    points = lambda column, n: F.when(F.col(column), n).otherwise(0.0)
    own = (
        F.when((F.col("st") == "Experiment") & (F.col("dt") == "Result"), points("b_numeric", 0.05) + F.when(F.col("a_section") != F.col("b_section"), 0.02).otherwise(0.0))
        .when((F.col("st") == "Result") & (F.col("dt") == "Hypothesis"), points("b_cue", 0.04))
        .when((F.col("st") == "Technique") & (F.col("dt") == "Result"), points("a_method", 0.02))
        .when((F.col("st") == "Dataset") & (F.col("dt") == "Result"), points("b_shown", 0.02) - F.when(F.col("b_numeric"), 0.0).otherwise(0.06))
        .otherwise(0.0)
    )
    return F.least(F.lit(0.04), shared * 0.015) + F.when(F.arrays_overlap("a_ref", "b_ref"), 0.04).otherwise(0.0) + own


def threshold(gap: Column, pages: Column, base: float = dims.EDGE_MIN) -> Column:
    near = F.when(gap <= 1, 0.05).when(gap <= 2, 0.03).otherwise(0.0) + F.when(pages == 0, 0.02).otherwise(0.0)
    far = F.when(gap >= 8, 0.04).otherwise(0.0) + F.when(pages >= 2, 0.03).otherwise(0.0)
    return F.greatest(F.lit(0.40), F.least(F.lit(0.70), F.lit(base) - near + far))


def proximity_edges(candidates: DataFrame) -> DataFrame:
    """(doc_id, src, dst, type, conf, hint) of candidates that pass the threshold of their distance, each on its own."""
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("ca") + F.col("cb")) / 2 + F.col("extra")))
    return candidates.withColumn("c", conf).where("c >= least").select("doc_id", "src", "dst", "type", F.round("c", 3).alias("conf"), F.lit("prox").alias("hint"))


def reinforced(candidates: DataFrame, bonus: float = dims.REINFORCEMENT) -> DataFrame:
    """(doc_id, src, dst, type, conf, nth): proximity links where each accepted link raises both ends' confidence before
    the next is weighed; and a row with dst null for each node that was raised, conf being its last.

    The order is link kind, distance, source, target. Candidates are dealt by document and sorted; a task folds one
    document after another as their rows stream by and holds the confidences of one document.
    """
    names = ["doc_id", "src", "dst", "type", "conf", "nth"]

    def fold(batches):
        doc, now, raised, links = None, {}, {}, 0

        def closed(out):
            out += [(doc, n, None, None, now[n], None) for n in raised]

        for batch in batches:
            out: list[tuple] = []
            for row_doc, src, dst, ca, cb, extra, least, kind in zip(*(c.to_pylist() for c in batch.columns)):
                if row_doc != doc:
                    closed(out)
                    doc, now, raised, links = row_doc, {}, {}, 0
                a, b = now.setdefault(src, ca), now.setdefault(dst, cb)
                c = min(1.0, max(0.0, (a + b) / 2 + extra))
                if c >= least:
                    out.append((doc, src, dst, kind, c, links))
                    links += 1
                    raised[src] = raised[dst] = True
                    now[src], now[dst] = min(1.0, a + bonus), min(1.0, b + bonus)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        last: list[tuple] = []
        closed(last)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in last], t) for i, t in enumerate(types)], names)

    key = candidates.schema["doc_id"].dataType
    types = [to_arrow_type(key), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32()]
    dealt = candidates.select("doc_id", "src", "dst", "ca", "cb", "extra", "least", "type", "ord", "gap").repartition("doc_id").sortWithinPartitions("doc_id", "ord", "gap", "src", "dst")
    return dealt.drop("ord", "gap").mapInArrow(fold, f"doc_id {key.simpleString()}, src int, dst int, type string, conf double, nth int")


def raised(nodes: DataFrame, folded: DataFrame) -> DataFrame:
    """nodes with the confidence that the fold left them with."""
    last = folded.where("dst is null").select("doc_id", F.col("src").alias("node_idx"), F.col("conf").alias("last"))
    return nodes.join(last, ["doc_id", "node_idx"], "left").withColumn("conf", F.coalesce("last", "conf")).drop("last").select(*nodes.columns)


def long_edges(spark: SparkSession, nodes: DataFrame, near: DataFrame) -> DataFrame:
    """Links over any distance between given sections, nodes: features; pairs that proximity linked do not count towards
    the quota, nor does a pair that an earlier kind took."""
    specs = F.broadcast(spark.createDataFrame([(*row, i) for i, row in enumerate(dims.LONG)], LONG_SPEC))
    a, b = _side(nodes, "a", [*PLACE, "conf", "polarity", "tok"]), _side(nodes, "b", [*PLACE, "conf", "tok", "numeric", "cue"])
    gap = F.col("b_sent_idx") - F.col("a_sent_idx")
    rank = lambda c: dims.lookup(dims.RANK, F.col(c), default=99)
    pairs = (
        a.join(specs, (F.col("a_type") == F.col("st")) & F.expr("array_contains(from_secs, a_section)"))
        .join(b, (F.col("a_doc_id") == F.col("b_doc_id")) & (F.col("b_type") == F.col("dt")) & F.expr("array_contains(to_secs, b_section)") & (gap > 0))
        .where(rank("a_section") <= rank("b_section"))
        .withColumn("gap", gap)
    )
    conf = (F.col("a_conf") + F.col("b_conf")) / 2 + F.col("bonus")
    conf = conf + F.when((F.col("st") == "Experiment") & F.col("b_numeric"), 0.04).when((F.col("st") == "Result") & F.col("b_cue"), 0.03).otherwise(0.0)
    conf = conf - F.when(F.col("gap") > 12, F.least(F.lit(0.14), (F.col("gap") - 12) * 0.004)).otherwise(0.0)
    conf = conf + F.least(F.lit(0.03), F.size(F.array_intersect("a_tok", "b_tok")) * 0.01)
    kind = F.when((F.col("st") == "Result") & (F.col("a_polarity") == "negative"), "refutes").otherwise(F.col("etype"))
    narrow = pairs.withColumn("c", F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))).where("c >= min_conf").select(
        F.col("a_doc_id").alias("doc_id"), F.col("a_node_idx").alias("src"), F.col("b_node_idx").alias("dst"), "ord", "per_src", "gap", "c", kind.alias("type")
    )
    best = Window.partitionBy("doc_id", "ord", "src").orderBy(F.desc("c"), "gap", "dst")
    rows = narrow.join(near.select("doc_id", "src", "dst").distinct(), ["doc_id", "src", "dst"], "left_anti").withColumn("k", F.row_number().over(best)).where("k <= per_src")
    return rows.select("doc_id", "src", "dst", "type", F.round("c", 3).alias("conf"), F.lit("longrange").alias("hint"), "ord", "k")


def figure_edges(nodes: DataFrame, most: int = 3) -> DataFrame:
    """Captions to the next nodes that name the same figure or table. nodes need place and text."""
    refs = nodes.select("doc_id", "node_idx", "sent_idx", "type", F.col("place").isin("FigureCaption", "TableCaption").alias("caption"), F.explode(X.references(F.col("text"))).alias("ref"))
    a = refs.where("caption").select("doc_id", "ref", F.col("node_idx").alias("src"), F.col("sent_idx").alias("sa"))
    b = refs.where("not caption").select("doc_id", "ref", F.col("node_idx").alias("dst"), F.col("sent_idx").alias("sb"), "type")
    near = Window.partitionBy("doc_id", "ref", "src").orderBy("gap", "dst")
    pairs = a.join(b, ["doc_id", "ref"]).where("sb > sa").withColumn("gap", F.col("sb") - F.col("sa"))
    kind = F.when(F.col("type").isin("Result", "Conclusion"), "summarizes").otherwise("informs")
    hint = F.when(F.col("ref").startswith("F"), "figure").otherwise("table")
    kept = pairs.withColumn("k", F.row_number().over(near)).where(F.col("k") <= most)
    return kept.select("doc_id", "src", "dst", kind.alias("type"), F.lit(0.6).alias("conf"), hint.alias("hint"), "ref", "k")


def all_edges(folded: DataFrame, far: DataFrame, figures: DataFrame) -> DataFrame:
    """Links of every kind with pos, their order: proximity, long range, figures, tables."""
    near = folded.where("dst is not null").select("doc_id", "src", "dst", "type", F.round("conf", 3).alias("conf"), F.lit("prox").alias("hint"), F.struct(F.lit(0).alias("a"), F.col("nth").alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d"), F.lit("").alias("e")).alias("pos"))
    far = far.select("doc_id", "src", "dst", "type", "conf", "hint", F.struct(F.lit(1).alias("a"), F.col("ord").alias("b"), F.col("src").alias("c"), F.col("k").alias("d"), F.lit("").alias("e")).alias("pos"))
    figures = figures.select("doc_id", "src", "dst", "type", "conf", "hint", F.struct(F.when(F.col("hint") == "figure", 2).otherwise(3).alias("a"), F.col("src").alias("b"), F.col("k").alias("c"), F.col("dst").alias("d"), F.col("ref").alias("e")).alias("pos"))
    return near.unionByName(far).unionByName(figures)


def safe_links(nodes: DataFrame, linked: DataFrame, result: float = 0.65, hypothesis: float = 0.60, technique: float = 0.60) -> DataFrame:
    """For documents without a link: the surest Result to the surest Hypothesis, if both are sure enough, and the surest
    Technique to that Result, else that Hypothesis. Off unless asked for."""
    order = F.struct(-F.col("conf"), "node_idx")
    top = lambda t: F.min(F.when(F.col("type") == t, order))
    per = nodes.join(linked.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(
        top("Result").alias("r"), top("Hypothesis").alias("h"), top("Technique").alias("t"), F.min_by("polarity", F.when(F.col("type") == "Result", order)).alias("outcome")
    )
    conf, node = lambda x: -F.col(f"{x}.col1"), lambda x: F.col(f"{x}.node_idx")
    mean = lambda a, b: F.round((a + b) / 2, 3)
    first = F.struct(node("r").alias("src"), node("h").alias("dst"), F.when(F.col("outcome") == "negative", "refutes").otherwise("supports").alias("type"), mean(conf("r"), conf("h")).alias("conf"))
    target, sure = F.coalesce(node("r"), node("h")), F.coalesce(conf("r"), conf("h"))
    second = F.struct(node("t").alias("src"), target.alias("dst"), F.lit("uses").alias("type"), mean(conf("t"), sure).alias("conf"))
    both = F.array(F.when((conf("r") >= result) & (conf("h") >= hypothesis), first), F.when((conf("t") >= technique) & (sure >= technique), second))
    return per.select("doc_id", F.explode(F.array_compact(both)).alias("x")).select("doc_id", "x.*")
