"""Fixed values and small dimension tables of the graph engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node types in column order, and the order that settles equal scores.
TYPES = ["Input Fact", "Hypothesis", "Experiment", "Technique", "Result", "Dataset", "Analysis", "Conclusion"]
TIE_ORDER = ["Result", "Experiment", "Technique", "Analysis", "Dataset", "Hypothesis", "Conclusion", "Input Fact", "Other"]
# Score multipliers by section and type, and by type.
PRIORS = {
    ("ABSTRACT", "Hypothesis"): 1.18, ("INTRO", "Hypothesis"): 1.25, ("INTRO", "Input Fact"): 1.06,
    ("METHODS", "Technique"): 1.15, ("METHODS", "Experiment"): 1.12, ("METHODS", "Dataset"): 1.10, ("METHODS", "Analysis"): 1.05,
    ("RESULTS", "Result"): 1.18, ("RESULTS", "Analysis"): 1.08,
    ("DISCUSSION", "Conclusion"): 1.20, ("DISCUSSION", "Result"): 1.12, ("DISCUSSION", "Hypothesis"): 0.92,
    ("DISCUSSION", "Dataset"): 0.95, ("DISCUSSION", "Analysis"): 1.03, ("CONCLUSION", "Conclusion"): 1.22, ("OTHER", "Input Fact"): 1.02,
}
BASE = {"Input Fact": 1.00, "Hypothesis": 1.12, "Experiment": 1.08, "Technique": 1.04, "Result": 1.15, "Dataset": 1.06, "Analysis": 1.05, "Conclusion": 1.10}
# Hedging words; thresholds and bonuses.
HEDGES = ["may", "might", "could", "appears", "appeared", "seems", "seemed", "likely", "tend", "tends", "potentially", "approximately", "suggest", "suggests", "suggested", "possibly", "probable", "plausible"]
HEDGE_PENALTY, NUMERIC_BONUS, NODE_MIN, EDGE_MIN, GRAPH_MIN = 0.08, 0.06, 0.40, 0.52, 0.55
# Words that do not count as shared, and cues of support.
STOPWORDS = ["the", "and", "or", "of", "to", "in", "for", "on", "with", "by", "an", "a", "was", "were", "is", "are", "this", "that", "these", "those", "from", "as", "using", "use", "our", "their", "we", "they", "it", "at", "be"]
CUES = ["suggest", "indicate", "support", "confirm", "demonstrate", "show", "reveal"]
# Lemmas of outcomes, and phrases of a missing effect.
POSITIVE = ["demonstrate", "show", "increase", "improve", "enhance", "benefit", "boost", "broaden", "expand", "raise", "validate", "confirm", "corroborate", "replicate", "support", "fit", "correlate", "outperform", "reduce"]
NEGATIVE = ["decrease", "worsen", "worse", "fail", "lack"]
NEUTRALISED = ["decrease", "worsen", "worse"]
NEGATIVE_PHRASES = ["not significant", "not statistically significant", "non significant", "non-significant", "null result", "negative result"]
# Proximity links (source, target, type, order, max_forward, max_k, max_page, min_conf, bonus).
PROXIMITY = [
    ("Technique", "Experiment", "uses", 1, 10, 3, 2, 0.52, 0.0),
    ("Technique", "Result", "uses", 2, 14, 2, 2, 0.52, 0.02),
    ("Experiment", "Result", "produces", 3, 24, 4, 3, 0.55, 0.04),
    ("Result", "Hypothesis", "supports", 4, 28, 4, 3, 0.53, 0.0),
    ("Dataset", "Experiment", "feeds", 5, 16, 2, 3, 0.52, 0.0),
    ("Dataset", "Analysis", "feeds", 6, 18, 2, 3, 0.52, 0.0),
    ("Analysis", "Result", "informs", 7, 14, 2, 2, 0.52, 0.0),
    ("Result", "Result", "follows", 8, 14, 2, 2, 0.52, 0.0),
    ("Dataset", "Result", "summarizes", 9, 14, 2, 3, 0.58, 0.0),
]
# Long links (source, target, type, source sections, target sections, bonus, min_conf, max per source).
LONG = [
    ("Hypothesis", "Experiment", "tests", ["INTRO", "ABSTRACT"], ["METHODS"], 0.06, 0.58, 1),
    ("Experiment", "Result", "produces", ["METHODS"], ["RESULTS", "DISCUSSION"], 0.05, 0.60, 2),
    ("Result", "Conclusion", "supports", ["RESULTS", "DISCUSSION"], ["CONCLUSION", "DISCUSSION"], 0.05, 0.57, 1),
]
RANK = {"ABSTRACT": 0, "INTRO": 1, "INTRODUCTION": 1, "BACKGROUND": 1, "METHODS": 2, "RESULTS": 3, "DISCUSSION": 4, "CONCLUSION": 5, "CONCLUSIONS": 5, "OTHER": 6, "REFERENCES": 7}
# Relations allowed between types, and the default of a pair ("" : supports).
ALLOWED = {
    ("Input Fact", "Hypothesis"): (["supports", "refutes", "informs"], "informs"),
    ("Hypothesis", "Experiment"): (["tests"], "tests"),
    ("Technique", "Experiment"): (["uses"], "uses"),
    ("Dataset", "Experiment"): (["feeds", "used_by"], "feeds"),
    ("Experiment", "Result"): (["produces"], "produces"),
    ("Result", "Hypothesis"): (["supports", "refutes"], "supports"),
    ("Result", "Analysis"): (["informs"], "informs"),
    ("Dataset", "Analysis"): (["informs"], "informs"),
    ("Technique", "Analysis"): (["uses"], "uses"),
    ("Technique", "Result"): (["uses", "informs"], "uses"),
    ("Analysis", "Conclusion"): (["supports", "refutes", "summarizes"], "summarizes"),
    ("Result", "Conclusion"): (["supports", "refutes"], "supports"),
    ("Result", "Result"): (["follows", "informs"], "supports"),
    ("Dataset", "Result"): (["summarizes", "informs"], "supports"),
}
BACKBONE = [("Result", "Hypothesis", "supports"), ("Technique", "Experiment", "uses"), ("Dataset", "Experiment", "feeds"), ("Analysis", "Conclusion", "summarizes"), ("Input Fact", "Hypothesis", "informs")]
# Rows of a type in a language-model payload.
PAYLOAD = {"Result": 25, "Hypothesis": 15, "Experiment": 12, "Conclusion": 12, "Technique": 10, "Dataset": 10, "Analysis": 10, "Input Fact": 8}

# Section names and the standard section that each stands for; types that older packs spell otherwise.
IMRAD = {
    "INTRO": "INTRODUCTION", "BACKGROUND": "INTRODUCTION", "METHODS": "METHODS", "MATERIALS AND METHODS": "METHODS", "RESULTS": "RESULTS",
    "RESULTS AND DISCUSSION": "DISCUSSION", "DISCUSSION": "DISCUSSION", "CONCLUSION": "CONCLUSION", "CONCLUSIONS": "CONCLUSION", "OTHER": "OTHER",
    "UNKNOWN": "OTHER", "ABSTRACT": "INTRODUCTION", "REFERENCES": "REFERENCES", "BIBLIOGRAPHY": "REFERENCES",
}
SYNONYMS = {"input": "Input Fact", "hyp": "Hypothesis"}
# What a caption and a structural citation add, and to which types a caption does.
CAPTION_BOOST, CITED_FACT = 0.08, 0.12
CAPTIONED = ["Result", "Analysis", "Experiment", "Dataset"]
# What an accepted link adds to both of its nodes.
REINFORCEMENT = 0.02

#: The synthetic rule pack: rule, label, token sequence.
PACK = [
    ("R_THE", "Result", ["the", "and"]), ("D_OF", "Dataset", ["of"]), ("I_IN", "Input Fact", ["in"]), ("A_IS", "Analysis", ["is"]),
    ("H_THAT", "Hypothesis", ["that"]), ("C_ON", "Conclusion", ["on"]), ("E_WITH", "Experiment", ["with"]), ("T_OR", "Technique", ["or"]),
]


def lookup(table: dict, *keys: Column, default: object) -> Column:
    """A small map as a chain of CASE branches."""
    out = F.lit(default)
    for key, value in reversed(table.items()):
        key = key if isinstance(key, tuple) else (key,)
        test = F.lit(True)
        for column, wanted in zip(keys, key):
            test = test & (column == wanted)
        out = F.when(test, F.lit(value)).otherwise(out)
    return out
