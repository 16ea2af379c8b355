"""The integer scorer: rule weights, section priors, boosts by cue, section order on near ties, guards.

One score column for each label; a sentence is one row throughout, so after the hits are grouped nothing shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.plans import dims

# Points of a label by section.
PRIORS = {
    "ABSTRACT": {"Hypothesis": 1},
    "INTRO": {"Input Fact": 1, "Hypothesis": 2},
    "METHODS": {"Experiment": 2, "Technique": 2, "Dataset": 1, "Analysis": 1},
    "RESULTS": {"Result": 2, "Analysis": 1},
    "DISCUSSION": {"Conclusion": 2, "Result": 1, "Hypothesis": 1},
    "CONCLUSION": {"Conclusion": 2},
}
# Order of labels on near ties by section, and elsewhere.
ORDERS = {
    "ABSTRACT": ["Hypothesis", "Input Fact", "Conclusion", "Result", "Dataset", "Technique", "Analysis", "Experiment"],
    "INTRO": ["Hypothesis", "Input Fact", "Conclusion", "Result", "Analysis", "Technique", "Experiment", "Dataset"],
    "METHODS": ["Technique", "Experiment", "Dataset", "Analysis", "Result", "Input Fact", "Hypothesis", "Conclusion"],
    "RESULTS": ["Result", "Analysis", "Dataset", "Technique", "Experiment", "Conclusion", "Input Fact", "Hypothesis"],
    "DISCUSSION": ["Conclusion", "Result", "Analysis", "Technique", "Experiment", "Dataset", "Input Fact", "Hypothesis"],
    "CONCLUSION": ["Conclusion", "Result", "Analysis", "Technique", "Experiment", "Dataset", "Input Fact", "Hypothesis"],
}
ELSEWHERE = ["Conclusion", "Result", "Analysis", "Technique", "Experiment", "Dataset", "Input Fact"]
# The order in which labels are listed, which settles ties that an order leaves open.
LABELS = ["Input Fact", "Hypothesis", "Experiment", "Technique", "Result", "Dataset", "Analysis", "Conclusion"]
# Rules behind each cue.
CUES = {
    "summary": ["RES_SUMMARY", "RES_VERB_CUES", "RES_WE_VERB", "RES_STATS"],
    "stats": ["RES_STATS"],
    "test": ["ANA_SURFACE", "ANA_DEP", "ANA_USING"],
    "hypothesis": ["HYP_SURFACE"],
    "operation": ["EXP_SURFACE", "EXP_DOBJ"],
    "technique": ["TEC_USING", "TEC_SURFACE"],
    "data": ["DATA_SURFACE"],
    "literature": ["INF_PREV_ASSOC", "INF_ASSOC_SUBJ_LIT"],
    "citation": ["INF_CIT_BRACK_NUM", "INF_CIT_PAREN_AUTHOR_YEAR", "INF_CIT_PAREN_YEAR_ONLY", "INF_CIT_ETAL_YEAR", "INF_CIT_DOI"],
    "head_results": ["RES_ABS_HEAD_RESULTS"],
    "head_conclusion": ["CONC_ABS_HEAD"],
}
# Points of citations, a structural one and one found by a rule.
CITED, CITED_BY_RULE = 4, 3
SIGNIFICANT = ["significant", "significantly", "significance"]


def rule_points(pack: list[dict], default: int = 1) -> list[tuple[str, str, int, list[str]]]:
    """(rule, label, points, sections) of a pack, with demoted labels at -1 and citation rules' extra."""
    out = []
    for rule in pack:
        meta = rule.get("meta", {})
        sections = [s.upper() for s in meta.get("sections", [])]
        out.append((rule["name"], meta.get("label") or rule["label"], meta.get("weight", default), sections))
        out += [(rule["name"], label, -1, sections) for label in meta.get("demote", [])]
        if rule["name"].startswith("INF_CIT_"):
            out.append((rule["name"], "Input Fact", CITED_BY_RULE, sections))
    return out


def labelled(sentences: DataFrame, counts: DataFrame, pack: list[dict], soft: bool = True) -> DataFrame:
    """(doc_id, sent_idx, label, best): each sentence with its label, OTHER if nothing fits, and its highest score.

    sentences: doc_id, sent_idx, section, text, has_citation (null: false); counts: doc_id, sent_idx, rule, hits.
    A hit counts in its rule's sections only but shows as a cue in all. With soft, an Input Fact that rests on citation
    rules alone, without a structural citation, is OTHER.
    """
    hits = counts.groupBy("doc_id", "sent_idx").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.col("hits").cast("int").alias("hits")))).alias("h"))
    rows = sentences.select("doc_id", "sent_idx", F.upper("section").alias("section"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("has_citation", F.lit(False)).alias("cited"))
    rows = rows.join(hits, ["doc_id", "sent_idx"], "left")
    n = lambda rule: F.coalesce(F.try_element_at("h", F.lit(rule)), F.lit(0))
    rows = rows.withColumns({f"cue_{cue}": reduce(Column.__or__, [n(rule) > 0 for rule in rules]) for cue, rules in CUES.items()})
    rows = rows.withColumns({
        "cue_citation": F.col("cue_citation") | F.col("cited"),
        "significant": F.col("cue_stats") | F.arrays_overlap(X.tokens(F.col("text")), F.array(*[F.lit(w) for w in SIGNIFICANT])),
        "percents": F.regexp_count("text", F.lit("%")) >= 2,
    })
    cue, section = lambda c: F.col(f"cue_{c}"), F.col("section")
    opening = section.isin("INTRO", "ABSTRACT")
    when = lambda test, points: F.when(test, points).otherwise(0)
    abstract = section == "ABSTRACT"
    boosts = {
        "Analysis": [when(cue("test"), 3)],
        "Result": [when(cue("summary"), 3), when(abstract & cue("head_results"), 2), when(abstract & F.col("percents"), 1)],
        "Hypothesis": [when(cue("hypothesis") & opening, 2)],
        "Experiment": [when(cue("operation"), 2)],
        "Technique": [when(cue("technique"), 2)],
        "Dataset": [
            when(cue("data") & ~F.col("significant") & ~(opening & cue("literature")), 2),
            when(section.isin("ABSTRACT", "METHODS") & cue("data") & ~F.col("significant") & ~cue("test"), 1),
        ],
        "Input Fact": [when(opening & cue("citation"), 1), when(F.col("cited"), CITED)],
        "Conclusion": [when(abstract & cue("head_conclusion"), 2)],
    }
    points = {label: [F.lit(0)] for label in LABELS}
    for rule, label, weight, sections in rule_points(pack):
        gate = section.isin(*sections) if sections else F.lit(True)
        points.setdefault(label, [F.lit(0)]).append(when(gate, n(rule) * F.lit(weight)))
    for at, table in PRIORS.items():
        for label, weight in table.items():
            points[label].append(when(section == at, weight))
    rows = rows.withColumns({f"s_{label}": reduce(Column.__add__, points[label] + boosts[label]) for label in LABELS})
    aims = opening & cue("hypothesis") & (F.col("s_Technique") > 0)
    rows = rows.withColumns({"s_Hypothesis": F.col("s_Hypothesis") + when(aims, 2), "s_Technique": F.col("s_Technique") - when(aims, 1)})
    rows = rows.withColumn("best", F.greatest(*[F.col(f"s_{label}") for label in LABELS]))
    return rows.withColumn("chosen", _chosen()).select("doc_id", "sent_idx", _guarded(soft).alias("label"), "best")


def _chosen() -> Column:
    """The first label, in the section's order, within one point of the best; labels outside of the order come last, if best."""
    def first(order: list[str]) -> Column:
        rest = [label for label in LABELS if label not in order]
        near = [F.when(F.col(f"s_{label}") >= F.col("best") - 1, F.lit(label)) for label in order]
        return F.coalesce(*near, *[F.when(F.col(f"s_{label}") == F.col("best"), F.lit(label)) for label in rest])

    return reduce(lambda out, section: F.when(F.col("section") == section, first(ORDERS[section])).otherwise(out), ORDERS, first(ELSEWHERE))


def _guarded(soft: bool) -> Column:
    """The choice after the cues that overrule it, then the guards."""
    c, section = F.col("chosen"), F.col("section")
    to = F.when(section.isin("DISCUSSION", "INTRO", "ABSTRACT"), "Conclusion").otherwise("Result")
    out = (
        F.when((c == "Technique") & F.col("cue_test"), "Analysis").when((c == "Technique") & F.col("cue_summary"), to)
        .when((c == "Dataset") & F.col("significant"), "Result").otherwise(c)
    )
    none = F.col("h").isNull() & ~F.col("cited")
    out = F.when((section == "REFERENCES") | none, F.when(section == "RESULTS", "Result").otherwise("OTHER")).otherwise(out)
    looks = F.col("text").rlike(X.REFERENCE_WORD) | (F.col("text").rlike(X.YEAR) & F.col("text").rlike(X.PAGES))
    out = F.when(looks, "OTHER").otherwise(out)
    if soft:
        names = F.map_keys("h")
        cites = lambda r: r.startswith("INF_CIT_") | (r == "INF_CITATION")
        out = F.when((out == "Input Fact") & ~F.col("cited") & F.exists(names, cites) & F.forall(names, cites), "OTHER").otherwise(out)
    return out


#: A pack over words that plain prose has, with the names that the cues look for.
PACK = [
    {"name": "RES_STATS", "label": "Result", "patterns": [[{"LIKE_NUM": True}, {"ORTH": "%", "OP": "?"}]]},
    {"name": "TEC_USING", "label": "Technique", "patterns": [[{"LOWER": {"IN": ["with", "or"]}}, {"LOWER": "the", "OP": "?"}]], "meta": {"sections": ["METHODS", "RESULTS"], "weight": 2}},
    {"name": "DATA_SURFACE", "label": "Dataset", "patterns": [[{"LOWER": "of"}, {"LOWER": {"IN": ["the", "a"]}}]]},
    {"name": "HYP_SURFACE", "label": "Hypothesis", "patterns": [[{"LOWER": "that"}], [{"LOWER": "if"}, {"IS_PUNCT": False}]], "meta": {"demote": ["Result"]}},
    {"name": "ANA_SURFACE", "label": "Analysis", "patterns": [[{"LEMMA": {"IN": ["call", "use"]}}], [{"LOWER": "is"}, {"LOWER": "not", "OP": "?"}, {"LOWER": {"IN": ["a", "in"]}}]]},
    {"name": "CONC_SURFACE", "label": "Conclusion", "patterns": [[{"IS_TITLE": True}, {"LOWER": "and"}]]},
]
assert set(LABELS) == set(dims.TYPES)
