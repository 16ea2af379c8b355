"""Regex rule packs: a pattern, vetoes, sections and a weight for each rule, and a router over theme triggers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regex_hits(sentences: DataFrame, rules: list[dict], themes: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, sent_idx, rule, type, weight): rules whose pattern occurs in the text, none of whose negatives does.

    rules: {id, type, weight, pattern, negatives, sections, theme}; matching ignores case; without sections a rule holds
    in all. The pack is small and fixed at plan time, so each sentence is read once and no join is needed; a theme's score
    multiplies the weight (1 if it has none). A null text has no hits.
    """
    if not rules:
        return sentences.select("doc_id", "sent_idx", F.lit("").alias("rule"), F.lit("").alias("type"), F.lit(0.0).alias("weight")).where("false")
    fired = F.array_compact(F.array(*[_fired(rule, (themes or {}).get(rule.get("theme"), 1.0)) for rule in rules]))
    return sentences.select("doc_id", "sent_idx", F.explode(fired).alias("hit")).select("doc_id", "sent_idx", "hit.rule", "hit.type", "hit.weight")


def _fired(rule: dict, score: float) -> Column:
    text = F.col("text")
    test = text.rlike("(?i)" + rule["pattern"])
    for negative in rule.get("negatives") or []:
        test = test & ~text.rlike("(?i)" + negative)
    if rule.get("sections"):
        test = F.upper("section").isin(*[s.upper() for s in rule["sections"]]) & test
    return F.when(test, F.struct(F.lit(rule["id"]).alias("rule"), F.lit(rule["type"]).alias("type"), F.lit(float(rule["weight"]) * score).alias("weight")))


def _word(token: str) -> str:
    quoted = "".join("\\" + c if c in r".^$*+?()[]{}|\-" else c for c in token.lower())
    return rf"(^|[^\p{{L}}\p{{N}}_]){quoted}($|[^\p{{L}}\p{{N}}_])"


def theme_scores(docs: DataFrame, triggers: list[dict], top: int = 2) -> DataFrame:
    """(doc_id, theme, score, rank): the best `top` themes of each document that reach their thresholds.

    triggers: {id, must, should: [[token, weight]], negative: [[token, weight]], threshold}. The score is the weight of
    the found should tokens less that of the found negatives; a theme with must tokens needs one of them. Equal scores
    rank by id. The array of themes is sorted within the row: no shuffle.
    """
    has = lambda token: F.lower("text").rlike(_word(token))
    found = []
    for t in triggers:
        add = lambda pairs: reduce(Column.__add__, [F.when(has(w), float(x)).otherwise(0.0) for w, x in pairs], F.lit(0.0))
        score = add(t.get("should") or []) - add(t.get("negative") or [])
        must = reduce(Column.__or__, [has(w) for w in t.get("must") or []]) if t.get("must") else F.lit(True)
        found.append(F.when(must, F.struct((-score).alias("order"), F.lit(t["id"]).alias("theme"), score.alias("score"), F.lit(float(t.get("threshold", 0.0))).alias("least"))))
    kept = F.filter(F.array_compact(F.array(*found)), lambda x: x["score"] >= x["least"])
    rows = docs.select("doc_id", F.posexplode(F.slice(F.array_sort(kept), 1, top)).alias("at", "t"))
    return rows.select("doc_id", "t.theme", "t.score", (F.col("at") + 1).alias("rank"))


#: Small packs over words that plain prose has.
RULES = [
    {"id": "plain/Result/count", "type": "Result", "weight": 0.64, "pattern": r"[0-9]+\s+(of|in)", "negatives": ["not"], "sections": ["RESULTS", "DISCUSSION"]},
    {"id": "plain/Technique/with", "type": "Technique", "weight": 0.6, "pattern": r"with\s+(the|a)", "negatives": [r"no\s+", "never"], "sections": []},
    {"id": "plain/Hypothesis/that", "type": "Hypothesis", "weight": 0.7, "pattern": r"that\s+(is|it|the)", "negatives": [], "sections": ["ABSTRACT", "INTRO"]},
]
TRIGGERS = [
    {"id": "prose", "must": ["the", "of"], "should": [["and", 1], ["in", 1], ["to", 0.5]], "negative": [["und", 1]], "threshold": 0.8},
    {"id": "romance", "must": [], "should": [["de", 1], ["la", 0.5], ["le", 0.5]], "negative": [["the", 0.5]], "threshold": 0.55},
    {"id": "german", "must": ["und", "der"], "should": [["die", 1], ["und", 0.6]], "negative": [], "threshold": 0.6},
]
