"""Token rules, scores and the decision chain that turns sentences into nodes: all within a sentence's row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.plans import dims


def _occurrences(joined: Column, words: list[str]) -> Column:
    """How often the words follow each other in tokens joined as <a><b><c>."""
    mark = "".join(f"<{w}>" for w in words)
    if any(words[:k] == words[-k:] for k in range(1, len(words))):  # occurrences may overlap
        return F.regexp_count(joined, F.lit(f"(?={mark})"))
    return ((F.length(joined) - F.length(F.replace(joined, F.lit(mark), F.lit("")))) / len(mark)).cast("int")


def matched(sentences: DataFrame, pack=dims.PACK) -> DataFrame:
    """sentences with counts: one number for each rule of the pack. Nothing is exploded, joined or shuffled."""
    joined = F.concat(F.lit("<"), F.array_join(X.tokens(F.col("text")), "><"), F.lit(">"))
    rows = sentences.withColumn("joined", joined)
    # Exploded from an array of one, so that no later filter is pushed below and counts again.
    counts = F.explode(F.array(F.array(*[_occurrences(F.col("joined"), words) for _, _, words in pack])))
    return rows.select("*", counts.alias("counts")).drop("joined")


def rule_hits(sentences: DataFrame, pack=dims.PACK) -> DataFrame:
    """(doc_id, sent_idx, rule, label, hits): the rules that a sentence meets."""
    found = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(label).alias("label"), F.get("counts", F.lit(i)).cast("long").alias("hits")) for i, (rule, label, _) in enumerate(pack)])
    return matched(sentences, pack).select("doc_id", "sent_idx", F.explode(F.filter(found, lambda h: h["hits"] > 0)).alias("h")).select("doc_id", "sent_idx", "h.*")


def hit_map(sentences: DataFrame, pack=dims.PACK) -> DataFrame:
    """(doc_id, sent_idx, rules): rule to hits, of the sentences with any."""
    entries = F.array(*[F.struct(F.lit(rule).alias("key"), F.get("counts", F.lit(i)).alias("value")) for i, (rule, _, _) in enumerate(pack)])
    found = matched(sentences, pack).withColumn("found", F.filter(entries, lambda x: x["value"] > 0))
    return found.where(F.size("found") > 0).select("doc_id", "sent_idx", F.map_from_entries("found").alias("rules"))


def scored(sentences: DataFrame, pack=dims.PACK, boosts: dict[str, float] | None = None) -> DataFrame:
    """sentences with scores, an array of (label, score) of the labels hit: hits times section prior, type weight and
    theme boost, with numeric bonus and hedging."""
    # Without a hit only what looks like a reference and bears a number among the results can become a node.
    some = F.exists("counts", lambda n: n > 0) | (F.col("section").startswith("RESULT") & F.col("text").rlike(X.NUMERIC_HINT))
    rows = matched(sentences, pack).where(some).withColumns({
        "bonus": F.when(X.has_numeric(F.col("text")), dims.NUMERIC_BONUS).otherwise(0.0),
        "hedge": F.when(F.arrays_overlap(X.tokens(F.col("text")), F.array(*[F.lit(h) for h in dims.HEDGES])), dims.HEDGE_PENALTY).otherwise(0.0),
    })
    entries = []
    for t in dims.TYPES:
        own = [F.get("counts", F.lit(i)) for i, (_, label, _) in enumerate(pack) if label == t]
        if own:
            raw = reduce(Column.__add__, own).cast("double")
            score = raw * dims.lookup({s: x for (s, label), x in dims.PRIORS.items() if label == t}, F.col("section"), default=1.0) * dims.BASE.get(t, 1.0) * (boosts or {}).get(t, 1.0)
            if t in ("Result", "Analysis", "Dataset"):
                score = score + F.col("bonus")
            entries.append(F.struct(F.lit(t).alias("label"), F.when(raw > 0, score - F.col("hedge")).alias("score")))
    return rows.withColumn("scores", F.filter(F.array(*entries), lambda x: x["score"].isNotNull())).drop("counts", "bonus", "hedge")


def best_types(rows: DataFrame) -> DataFrame:
    """scored rows with type, conf and conclusion (the score of Conclusion): the best label, ties by the fixed order; a
    sentence without a hit has type '' and conf 0."""
    order = lambda label: dims.lookup({t: -i for i, t in enumerate(dims.TIE_ORDER)}, label, default=-99)
    best = F.array_max(F.transform("scores", lambda x: F.struct(x["score"].alias("score"), order(x["label"]).alias("o"), x["label"].alias("label"))))
    own = F.get(F.filter("scores", lambda x: x["label"] == "Conclusion"), F.lit(0))
    rows = rows.withColumns({"best": best, "conclusion": F.coalesce(own["score"], F.lit(0.0))})
    return rows.withColumns({"type": F.coalesce(F.col("best.label"), F.lit("")), "conf": F.coalesce(F.col("best.score"), F.lit(0.0))}).drop("best", "scores")


def decided(rows: DataFrame) -> DataFrame:
    """The chain after scoring, each step on the outcome of the one before; rows below NODE_MIN stay out.

    rows: best_types; has_citation, citation_strength, is_caption and caption_type are read if they are there.
    """
    t, text, sec, conf = F.col("type"), F.col("text"), F.col("section"), F.col("conf")
    given = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)
    cited, strength = given("has_citation", False), given("citation_strength", 0.0)
    caption, kind = given("is_caption", False), given("caption_type", "")
    place = F.when(caption & kind.isin("Figure", "Table"), F.concat(kind, F.lit("Caption"))).otherwise("Body")
    rows = rows.withColumns({"cited": cited, "strength": F.when(strength > 0, strength).otherwise(X.citation_strength(text)), "captioned": caption & kind.isin("Figure", "Table"), "place": place})
    guard = (sec == "REFERENCES") | X.looks_like_reference(text)
    rows = rows.withColumns({"type": F.when(guard, "Other").otherwise(t), "conf": F.when(guard, 0.39).otherwise(conf)})
    gain = F.least(F.lit(0.12), F.lit(0.08) * F.round(F.col("strength") * 10) / 10)
    rows = rows.withColumn("conf", F.when(t.isin("Input Fact", "Result", "Conclusion"), F.least(F.lit(1.0), conf + gain)).otherwise(conf))
    rows = rows.withColumn("conf", F.when(F.col("cited") & (t == "Input Fact"), F.least(F.lit(1.0), conf + dims.CITED_FACT)).otherwise(conf))
    rows = rows.withColumn("conf", F.when(X.citation_heavy(text), F.greatest(F.lit(0.0), conf - 0.08)).otherwise(conf))
    weak = (t == "Input Fact") & ~F.col("cited") & (conf < dims.NODE_MIN + 0.02)
    rows = rows.withColumns({"type": F.when(weak, "Other").otherwise(t), "conf": F.when(weak, 0.39).otherwise(conf)})
    low = F.trim(F.lower(text))
    opens = low.rlike("^(these results|overall|in conclusion|in summary)")
    says = low.rlike("suggest|indicate|support|imply|show")
    turns = (t != "") & (conf >= dims.NODE_MIN) & sec.isin("DISCUSSION", "RESULTS") & opens & says & (F.col("conclusion") >= conf * 0.9) & (t != "Conclusion")
    rows = rows.withColumns({"type": F.when(turns, "Conclusion").otherwise(t), "conf": F.when(turns & (sec == "DISCUSSION"), F.greatest("conf", F.lit(0.52))).otherwise(conf)})
    rows = rows.withColumn("conf", F.when(F.col("captioned") & t.isin(*dims.CAPTIONED), F.least(F.lit(1.0), conf + dims.CAPTION_BOOST)).otherwise(conf))
    pull = t.isin("Other", "Input Fact", "Analysis") & sec.startswith("RESULT") & text.rlike(X.NUMERIC_HINT)
    rows = rows.withColumns({"type": F.when(pull, "Result").otherwise(t), "conf": F.when(pull, F.greatest("conf", F.lit(0.46))).otherwise(conf)})
    # A filter on conf would be pushed through the steps, each of which it would write out several times over; explode stops it.
    out = ["doc_id", "sent_idx", "page", "section", "text", "place"]
    end = rows.select(*out, F.explode(F.array(F.struct("type", "conf"))).alias("end"))
    return end.where((F.col("end.type") != "") & (F.col("end.conf") >= dims.NODE_MIN)).select(*out, "end.type", F.round("end.conf", 3).alias("conf"))


def nodes(decisions: DataFrame) -> DataFrame:
    """decisions with node_idx (from 1 in each document), id and polarity."""
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    out = decisions.withColumn("node_idx", F.row_number().over(order))
    name = F.concat_ws(":", F.translate(F.col("doc_id").cast("string"), "/:", "--"), F.replace("type", F.lit(" "), F.lit("")), F.format_string("%04d", "node_idx"))
    return out.withColumns({"id": name, "polarity": X.polarity(F.col("text"))})


def decisions(sentences: DataFrame, pack=dims.PACK, boosts: dict[str, float] | None = None) -> DataFrame:
    return decided(best_types(scored(sentences, pack, boosts)))


def document_nodes(sentences: DataFrame, pack=dims.PACK, boosts: dict[str, float] | None = None) -> DataFrame:
    return nodes(decisions(sentences, pack, boosts))


def routed(sentences: DataFrame, pattern: str, cap: int = 400, enough: int = 6) -> DataFrame:
    """(doc_id, score) of a theme: hits over the first `cap` sentences, counting stops once `enough` are reached."""
    up = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.when(F.lower("text").rlike(pattern), 1).otherwise(0)
    run = sentences.where(F.col("sent_idx") < cap).withColumn("c", F.sum(hit).over(up))
    return run.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("c") >= enough, F.col("c"))), F.max("c")).alias("score"))


def themes(sentences: DataFrame, registry: dict[str, dict], cap: int = 400, enough: int = 6, least: int = 2) -> DataFrame:
    """(doc_id, theme, score, rank) of the themes that a document's first `cap` sentences reach `least` points for.

    A sentence that any of a theme's `any` patterns fits gives 2; one of the introduction that `intro_bias` fits 1; one of
    methods, results or no known section that `methods_bias` fits 1. Counting stops once `enough` are reached. common is
    no theme to choose. Equal scores stand in the registry's order.
    """
    names = [t for t in registry if t != "common"]
    if not names:
        return sentences.select("doc_id", F.lit("").alias("theme"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("rank")).limit(0)
    up = Window.partitionBy("doc_id").orderBy("sent_idx").rowsBetween(Window.unboundedPreceding, 0)
    section = F.upper("section")

    def points(t: dict) -> Column:
        fits = lambda field: F.col("text").rlike("(?i)" + "|".join(f"(?:{x})" for x in t[field])) if t.get(field) else F.lit(False)
        return F.when(fits("any"), 2).otherwise(0) + F.when((section == "INTRO") & fits("intro_bias"), 1).otherwise(0) + F.when(section.isin("METHODS", "OTHER", "RESULTS") & fits("methods_bias"), 1).otherwise(0)

    run = sentences.where(F.col("sent_idx") < cap).withColumns({f"c{i}": F.sum(points(registry[t])).over(up) for i, t in enumerate(names)})
    score = lambda c: F.coalesce(F.min(F.when(F.col(c) >= enough, F.col(c))), F.max(c))
    per = run.groupBy("doc_id").agg(*[score(f"c{i}").alias(f"c{i}") for i in range(len(names))])
    rows = per.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("theme"), F.col(f"c{i}").alias("score")) for i, t in enumerate(names)])).alias("x")).select("doc_id", "x.*")
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "i")
    return rows.where(F.col("score") >= least).withColumn("rank", F.row_number().over(order)).drop("i")


def with_boxes(nodes: DataFrame, sentences: DataFrame) -> DataFrame:
    """nodes with the box of their sentence, as corners and as coords (x, y, w, h)."""
    boxes = sentences.select("doc_id", "sent_idx", "x0", "y0", "x1", "y1")
    out = nodes.join(boxes, ["doc_id", "sent_idx"], "left")
    return out.withColumn("coords", F.when(F.col("x0").isNotNull(), F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h")))).otherwise(F.array()))


def with_geometry(nodes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """nodes whose missing or negative page and missing coords come from the snapshot of the same node; page 0 and no
    coords where that has none either."""
    kept = snapshot.select("doc_id", "node_idx", F.col("page").alias("old_page"), F.col("coords").alias("old_coords"))
    rows = nodes.join(kept, ["doc_id", "node_idx"], "left")
    page = F.coalesce(F.when(F.col("page") >= 0, F.col("page")), F.when(F.col("old_page") >= 0, F.col("old_page")), F.lit(0))
    return rows.withColumns({"page": page, "coords": F.coalesce("coords", "old_coords", F.array().cast(snapshot.schema["coords"].dataType))}).drop("old_page", "old_coords")
