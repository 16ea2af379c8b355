"""DuckDB SQL for token patterns, the integer scorer, regex rules and theme triggers."""

from __future__ import annotations

from itertools import product

from quillgraph import oracles as O
from quillgraph.functions import text as X
from quillgraph.operators import labeler as L
from quillgraph.operators import patterns as P
from quillgraph.operators import regexrules as Q

q = O.q


def _in(column: str, words) -> str:
    return f"{column} IN ({', '.join(q(w) for w in words)})"


def _test(attribute: str, value, x: str) -> str:
    """One attribute of one token; the packs here use these forms only."""
    if attribute == "LIKE_NUM":
        return f"(regexp_full_match({x}, '[0-9]+(?:[.,/][0-9]+)*') OR {_in(f'lower({x})', P.NUMBER_WORDS)}) = {value}"
    if attribute == "IS_PUNCT":
        return f"regexp_full_match({x}, '\\p{{P}}+') = {value}"
    if attribute == "IS_TITLE":
        return f"regexp_full_match({x}, '[^\\p{{L}}]*\\p{{Lu}}\\p{{Ll}}*([^\\p{{L}}]+\\p{{Lu}}\\p{{Ll}}*)*[^\\p{{L}}]*') = {value}"
    words = value["IN"] if isinstance(value, dict) else [value]
    if attribute == "LEMMA":
        words = [form for w in words for form in X.inflections(w)]
    return _in(x if attribute == "ORTH" else f"lower({x})", words)


def _spans(pack: list[dict]) -> str:
    """Optional steps are written out: one SELECT for each choice of them."""
    out = []
    for rule in pack:
        gate = [_in("section", rule["meta"]["sections"])] if rule.get("meta", {}).get("sections") else []
        for pattern in rule["patterns"]:
            for taken in product(*[(True, False) if step.get("OP") == "?" else (True,) for step in pattern]):
                steps = [step for step, take in zip(pattern, taken) if take]
                tests = [_test(a, v, f"tok[i + {k}]") for k, step in enumerate(steps) for a, v in step.items() if a != "OP"]
                out.append(f"SELECT doc_id, sent_idx, {q(rule['name'])} AS rule, {q(rule['label'])} AS label, CAST(i - 1 AS INTEGER) AS start, CAST(i - 1 + {len(steps)} AS INTEGER) AS \"end\" FROM tk WHERE {' AND '.join(gate + tests)}")
    return "\nUNION ".join(out)


S = f"parts AS ({O.CTE['parts']}), cut AS ({O.CTE['cut']}), s AS ({O.CTE['s']})"
HITS = (
    f"{S}, tl AS (SELECT doc_id, sent_idx, section, regexp_extract_all(text, {q(P.TOKEN)}) AS tok FROM s), "
    f"tk AS (SELECT doc_id, sent_idx, section, tok, unnest(range(1, len(tok) + 1)) AS i FROM tl), ph AS ({_spans(L.PACK)})"
)
PATTERN_HITS = f"WITH {HITS} SELECT * FROM ph"

SHORT = {label: label.replace(" ", "_") for label in L.LABELS}


def _first(order: list[str]) -> str:
    near = [f"CASE WHEN {SHORT[x]} >= best - 1 THEN {q(x)} END" for x in order]
    return f"coalesce({', '.join(near + [f'CASE WHEN {SHORT[x]} = best THEN {q(x)} END' for x in L.LABELS if x not in order])})"


def _prior(label: str) -> str:
    rows = [f"WHEN {q(s)} THEN {table[label]}" for s, table in L.PRIORS.items() if label in table]
    return f"CASE section {' '.join(rows)} ELSE 0 END" if rows else "0"


# By the rules of the pack: r RES_STATS, t TEC_USING (2 points in METHODS and RESULTS), d DATA_SURFACE, h HYP_SURFACE (takes 1 from Result), a ANA_SURFACE, c CONC_SURFACE.
LABELLED = (
    f"WITH {HITS}, pv AS (SELECT doc_id, sent_idx, true AS any_hit, " + ", ".join(f"count(*) FILTER (rule = {q(rule['name'])}) AS {rule['name'][0].lower()}" for rule in L.PACK) + " FROM ph GROUP BY ALL), "
    f"b0 AS (SELECT s.doc_id, s.sent_idx, section, text, coalesce(any_hit, false) AS any_hit, coalesce(r, 0) AS r, coalesce(t, 0) AS t, coalesce(d, 0) AS d, coalesce(h, 0) AS h, coalesce(a, 0) AS a, coalesce(c, 0) AS c, "
    f"({O.STRENGTH}) > 0 AS cited, section IN ('INTRO', 'ABSTRACT') AS opening FROM s LEFT JOIN pv USING (doc_id, sent_idx)), "
    f"b AS (SELECT *, r > 0 OR list_has_any({O.TOKENS.format('text')}, {O.listed(L.SIGNIFICANT)}) AS sig FROM b0), "
    f"p0 AS (SELECT *, CASE WHEN section IN ('METHODS', 'RESULTS') THEN 2 * t ELSE 0 END + {_prior('Technique')} + CASE WHEN t > 0 THEN 2 ELSE 0 END AS tec FROM b), "
    f"p1 AS (SELECT *, opening AND h > 0 AND tec > 0 AS aims FROM p0), "
    f"p AS (SELECT *, {_prior('Input Fact')} + CASE WHEN opening AND cited THEN 1 ELSE 0 END + CASE WHEN cited THEN 4 ELSE 0 END AS Input_Fact, "
    f"h + {_prior('Hypothesis')} + CASE WHEN h > 0 AND opening THEN 2 ELSE 0 END + CASE WHEN aims THEN 2 ELSE 0 END AS Hypothesis, {_prior('Experiment')} AS Experiment, tec - CASE WHEN aims THEN 1 ELSE 0 END AS Technique, "
    f"r - h + {_prior('Result')} + CASE WHEN r > 0 THEN 3 ELSE 0 END + CASE WHEN section = 'ABSTRACT' AND length(text) - length(replace(text, '%', '')) >= 2 THEN 1 ELSE 0 END AS Result, "
    f"d + {_prior('Dataset')} + CASE WHEN d > 0 AND NOT sig THEN 2 ELSE 0 END + CASE WHEN section IN ('ABSTRACT', 'METHODS') AND d > 0 AND NOT sig AND a = 0 THEN 1 ELSE 0 END AS Dataset, "
    f"a + {_prior('Analysis')} + CASE WHEN a > 0 THEN 3 ELSE 0 END AS Analysis, c + {_prior('Conclusion')} AS Conclusion FROM p1), "
    f"g AS (SELECT *, greatest({', '.join(SHORT.values())}) AS best FROM p), "
    "ch AS (SELECT *, CASE section " + " ".join(f"WHEN {q(s)} THEN {_first(order)}" for s, order in L.ORDERS.items()) + f" ELSE {_first(L.ELSEWHERE)} END AS chosen FROM g) "
    f"SELECT doc_id, sent_idx, CASE WHEN {O.guarded('text')} THEN 'OTHER' "
    "WHEN section = 'REFERENCES' OR NOT (any_hit OR cited) THEN CASE WHEN section = 'RESULTS' THEN 'Result' ELSE 'OTHER' END "
    "WHEN chosen = 'Technique' AND a > 0 THEN 'Analysis' WHEN chosen = 'Technique' AND r > 0 THEN CASE WHEN section IN ('DISCUSSION', 'INTRO', 'ABSTRACT') THEN 'Conclusion' ELSE 'Result' END "
    "WHEN chosen = 'Dataset' AND sig THEN 'Result' ELSE chosen END AS label, CAST(best AS INTEGER) AS best FROM ch"
)


def _regex_rule(rule: dict) -> str:
    tests = [f"regexp_matches(text, {q('(?i)' + rule['pattern'])})"] + [f"NOT regexp_matches(text, {q('(?i)' + n)})" for n in rule["negatives"]]
    if rule["sections"]:
        tests.append(_in("section", rule["sections"]))
    return f"SELECT doc_id, sent_idx, {q(rule['id'])} AS rule, {q(rule['type'])} AS type, {O.e(rule['weight'])} AS weight FROM s WHERE {' AND '.join(tests)}"


REGEX_HITS = f"WITH {S} " + " UNION ALL ".join(map(_regex_rule, Q.RULES))


def _theme(t: dict) -> str:
    word = lambda w: f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])')"
    score = " + ".join([f"CASE WHEN {word(w)} THEN {O.e(float(x * sign))} ELSE 0e0 END" for field, sign in (("should", 1), ("negative", -1)) for w, x in t[field]])
    must = " OR ".join(map(word, t["must"])) or "true"
    return f"SELECT doc_id, {q(t['id'])} AS theme, {score} AS score, {O.e(float(t['threshold']))} AS least FROM documents WHERE {must}"


THEMES = (
    "SELECT doc_id, theme, score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, theme) AS k FROM ("
    + " UNION ALL ".join(map(_theme, Q.TRIGGERS)) + ") WHERE score >= least) WHERE k <= 2"
)
