"""DuckDB SQL for the registered queries, put together from common table expressions.

Definitions and fixed values stand here in their own words, apart from those of the engine: of the code under test only
the synthetic rule pack and the split of documents into sections, which are inputs, are read.
"""

from __future__ import annotations

from quillgraph.plans.dims import PACK
from quillgraph.sources.readers import SECTION

# Fixed values, as SQL rows.
TYPES = "Input Fact,Hypothesis,Experiment,Technique,Result,Dataset,Analysis,Conclusion".split(",")
TIES = "Result,Experiment,Technique,Analysis,Dataset,Hypothesis,Conclusion,Input Fact,Other".split(",")
PRIOR_ROWS = (
    "('ABSTRACT', 'Hypothesis', 1.18e0), ('INTRO', 'Hypothesis', 1.25e0), ('INTRO', 'Input Fact', 1.06e0), ('METHODS', 'Technique', 1.15e0), ('METHODS', 'Experiment', 1.12e0), "
    "('METHODS', 'Dataset', 1.10e0), ('METHODS', 'Analysis', 1.05e0), ('RESULTS', 'Result', 1.18e0), ('RESULTS', 'Analysis', 1.08e0), ('DISCUSSION', 'Conclusion', 1.20e0), "
    "('DISCUSSION', 'Result', 1.12e0), ('DISCUSSION', 'Hypothesis', 0.92e0), ('DISCUSSION', 'Dataset', 0.95e0), ('DISCUSSION', 'Analysis', 1.03e0), ('CONCLUSION', 'Conclusion', 1.22e0), ('OTHER', 'Input Fact', 1.02e0)"
)
BASE_ROWS = "('Input Fact', 1.00e0), ('Hypothesis', 1.12e0), ('Experiment', 1.08e0), ('Technique', 1.04e0), ('Result', 1.15e0), ('Dataset', 1.06e0), ('Analysis', 1.05e0), ('Conclusion', 1.10e0)"
HEDGES = "may might could appears appeared seems seemed likely tend tends potentially approximately suggest suggests suggested possibly probable plausible".split()
STOPWORDS = "the and or of to in for on with by an a was were is are this that these those from as using use our their we they it at be".split()
CUES = "suggest indicate support confirm demonstrate show reveal".split()
GOOD = "demonstrate show increase improve enhance benefit boost broaden expand raise validate confirm corroborate replicate support fit correlate outperform reduce".split()
BAD, VOIDED = "decrease worsen worse fail lack".split(), "decrease worsen worse".split()
LINK_ROWS = (
    "('Technique', 'Experiment', 'uses', 1, 10, 3, 2, 0.52e0, 0e0), ('Technique', 'Result', 'uses', 2, 14, 2, 2, 0.52e0, 0.02e0), ('Experiment', 'Result', 'produces', 3, 24, 4, 3, 0.55e0, 0.04e0), "
    "('Result', 'Hypothesis', 'supports', 4, 28, 4, 3, 0.53e0, 0e0), ('Dataset', 'Experiment', 'feeds', 5, 16, 2, 3, 0.52e0, 0e0), ('Dataset', 'Analysis', 'feeds', 6, 18, 2, 3, 0.52e0, 0e0), "
    "('Analysis', 'Result', 'informs', 7, 14, 2, 2, 0.52e0, 0e0), ('Result', 'Result', 'follows', 8, 14, 2, 2, 0.52e0, 0e0), ('Dataset', 'Result', 'summarizes', 9, 14, 2, 3, 0.58e0, 0e0)"
)
LONG_ROWS = (
    "('Hypothesis', 'Experiment', 'tests', ['INTRO', 'ABSTRACT'], ['METHODS'], 0.06e0, 0.58e0, 1, 0), ('Experiment', 'Result', 'produces', ['METHODS'], ['RESULTS', 'DISCUSSION'], 0.05e0, 0.60e0, 2, 1), "
    "('Result', 'Conclusion', 'supports', ['RESULTS', 'DISCUSSION'], ['CONCLUSION', 'DISCUSSION'], 0.05e0, 0.57e0, 1, 2)"
)
ALLOWED_ROWS = (
    "('Input Fact', 'Hypothesis', ['supports', 'refutes', 'informs'], 'informs'), ('Hypothesis', 'Experiment', ['tests'], 'tests'), ('Technique', 'Experiment', ['uses'], 'uses'), "
    "('Dataset', 'Experiment', ['feeds', 'used_by'], 'feeds'), ('Experiment', 'Result', ['produces'], 'produces'), ('Result', 'Hypothesis', ['supports', 'refutes'], 'supports'), "
    "('Result', 'Analysis', ['informs'], 'informs'), ('Dataset', 'Analysis', ['informs'], 'informs'), ('Technique', 'Analysis', ['uses'], 'uses'), ('Technique', 'Result', ['uses', 'informs'], 'uses'), "
    "('Analysis', 'Conclusion', ['supports', 'refutes', 'summarizes'], 'summarizes'), ('Result', 'Conclusion', ['supports', 'refutes'], 'supports'), "
    "('Result', 'Result', ['follows', 'informs'], 'supports'), ('Dataset', 'Result', ['summarizes', 'informs'], 'supports')"
)
BACKBONE_ROWS = "('Result', 'Hypothesis', 'supports'), ('Technique', 'Experiment', 'uses'), ('Dataset', 'Experiment', 'feeds'), ('Analysis', 'Conclusion', 'summarizes'), ('Input Fact', 'Hypothesis', 'informs')"
PAYLOAD = {"Result": 25, "Hypothesis": 15, "Experiment": 12, "Conclusion": 12, "Technique": 10, "Dataset": 10, "Analysis": 10, "Input Fact": 8}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def e(x: float) -> str:
    return f"{x!r}e0"


def case(table: dict, *columns: str, default: str, show=e) -> str:
    rows = []
    for key, value in table.items():
        key = key if isinstance(key, tuple) else (key,)
        rows.append("WHEN " + " AND ".join(f"{c} = {q(k)}" for c, k in zip(columns, key)) + f" THEN {show(value)}")
    return "CASE " + " ".join(rows) + f" ELSE {default} END"


def listed(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def inside(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


NUMERIC = "(regexp_matches({0}, '[0-9]') OR contains({0}, '%') OR contains(lower({0}), ' p<') OR contains(lower({0}), ' p ='))"
TOKENS = "regexp_extract_all(lower({0}), '[a-zA-Z0-9]+')"


#: A sign that is no part of a word.
W = r"[^\p{L}\p{N}_]"


def guarded(c: str) -> str:
    """A bibliography's line, of any length."""
    words = f"regexp_matches({c}, {q(f'(?i)(^|{W})(vol|no|pp|doi|issn)($|{W})')}) OR regexp_matches({c}, {q('(?i)(^|' + W + r')et al[.][\p{L}\p{N}_]')})"
    pages = r")\d{1,4}\s*(–|-)\s*\d{1,4}($|"
    return f"({words} OR (regexp_matches({c}, {q(f'(^|{W})(19|20)[0-9][0-9]($|{W})')}) AND regexp_matches({c}, {q('(^|' + W + pages + W + ')')})))"


def reference(c: str) -> str:
    return f"(length({c}) >= 30 AND {guarded(c)})"


_AUTHOR = q(r"\([A-Z][A-Za-z-]+(\s+et\s+al\.)?(\s*&\s*[A-Z][A-Za-z-]+)?,?\s*\d\d\d\d[a-z]?\)")
_NUMBER = q(r"\[\d+(\s*(-|–)\s*\d+)?(\s*,\s*\d+)*\]")
_NO_CITE = q(r"(?i)\((n\s*=\s*\d+|p\s*(<|≤)\s*0\.\d+|Fig\.|Table|Eq\.)")
STRENGTH = (
    f"CASE WHEN regexp_matches(text, {_NO_CITE}) THEN CASE WHEN regexp_matches(text, {_NUMBER}) THEN 0.5e0 ELSE 0e0 END "
    f"WHEN regexp_matches(text, {_AUTHOR}) THEN 0.7e0 WHEN regexp_matches(text, {_NUMBER}) THEN 0.5e0 ELSE 0e0 END"
)
CITES = f"(len(regexp_extract_all(text, {_AUTHOR})) + len(regexp_extract_all(text, {_NUMBER})))"
HEAVY = f"({CITES} >= 2 OR ({CITES} >= 1 AND length(text) < 120))"
_NOTED = [rf"(^|{W})\d+(\.\d+)?\s?%", rf"(^|{W})by\s+\d+($|{W})", rf"(^|{W})p\s*(<|≤)\s*0\.0[1-5]($|{W})", rf"(^|{W})(AUC|RMSE)($|{W})"]
NOTED = "(" + " OR ".join(f"regexp_matches(text, {q('(?i)' + x)})" for x in _NOTED) + ")"


def _forms(lemmas) -> str:
    stem = lambda w: w.removesuffix("e")
    return listed([x for w in lemmas for x in (w, w + "s", stem(w) + "ed", stem(w) + "ing")])


def _met(lemmas, before: str) -> str:
    """Some word of the list whose word before it satisfies the condition on p."""
    return f"len(list_filter(range(1, len(tok) + 1), lambda i: list_contains({_forms(lemmas)}, tok[i]) AND ({before.format("CASE WHEN i > 1 THEN tok[i - 1] ELSE '' END")}))) > 0"


_NEGATED, _PLAIN = "{} IN ('not', 'never', 'n0t')", "{} NOT IN ('not', 'never', 'n0t')"
_GOOD = _met(GOOD, _PLAIN)
_HARM = (
    f"({inside('lower(text)', ['not significant', 'not statistically significant', 'non significant', 'non-significant', 'null result', 'negative result'])} "
    f"OR (NOT {_met(VOIDED, _NEGATED)} AND NOT {_met(VOIDED, "{} = 'no'")} AND {_met(BAD, _PLAIN)}))"
)
POLARITY = f"CASE WHEN {_GOOD} AND NOT {_HARM} THEN 'positive' WHEN {_HARM} AND NOT {_GOOD} THEN 'negative' ELSE 'neutral' END"
#: Words for polarity: the ending n't is a word of its own.
OUTCOME_TOKENS = "regexp_extract_all(regexp_replace(lower(text), 'n[''’]t', ' n0t ', 'g'), '[a-z0-9]+')"
EDGE_TOKENS = f"list_distinct(list_filter({TOKENS.format('text')}, lambda t: length(t) > 2 AND NOT list_contains({listed(STOPWORDS)}, t)))"
REFS = (
    "list_distinct(list_concat(list_transform(regexp_extract_all(text, '(?i)\\b(?:figure|fig[.])\\s*([ivxlc\\d]+)\\b', 1), lambda x: 'F' || upper(x)), "
    "list_transform(regexp_extract_all(text, '(?i)\\btable\\s*([ivxlc\\d]+)\\b', 1), lambda x: 'T' || upper(x))))"
)
LATE = "('RESULTS', 'DISCUSSION', 'CONCLUSION', 'CONCLUSIONS', 'RESULTS AND DISCUSSION')"
TYPE_ORDER = "list_position(" + "[" + ", ".join(q(t) for t in TIES) + "], label)"

CTE = {
    "parts": "SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS parts FROM documents",
    "cut": "SELECT doc_id, CAST(len(parts) AS INTEGER) AS n, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS sent_idx, unnest(parts) AS text FROM parts",
    "s": f"SELECT doc_id, sent_idx, n, text, CAST(sent_idx // 20 AS INTEGER) AS page, {SECTION} AS section, false AS has_citation, 0e0 AS citation_strength, false AS is_caption, '' AS caption_type FROM cut",
    "tl": f"SELECT doc_id, sent_idx, {TOKENS.format('text')} AS tok FROM s",
    "t": "SELECT doc_id, sent_idx, generate_subscripts(tok, 1) - 1 AS i, unnest(tok) AS token FROM tl",
    "steps": "SELECT * FROM (VALUES " + ", ".join(f"({q(r)}, {q(l)}, {len(ws)}, {i}, {q(w)})" for r, l, ws in PACK for i, w in enumerate(ws)) + ") v(rule, label, len, step, value)",
    "lined": "SELECT doc_id, sent_idx, rule, label, len, i - step AS start, count(DISTINCT step) AS met FROM t JOIN steps ON token = value GROUP BY ALL",
    "hits": "SELECT doc_id, sent_idx, rule, label, count(*) AS hits FROM lined WHERE met = len GROUP BY ALL",
    "raw": "SELECT doc_id, sent_idx, label, CAST(sum(hits) AS DOUBLE) AS raw FROM hits GROUP BY ALL",
    "priors": f"SELECT * FROM (VALUES {PRIOR_ROWS}) v(section, label, prior)",
    "bases": f"SELECT * FROM (VALUES {BASE_ROWS}) v(label, base)",
    "scores": f"SELECT raw.doc_id, raw.sent_idx, label, raw * coalesce(prior, 1e0) * coalesce(base, 1e0) "
    f"+ CASE WHEN label IN ('Result', 'Analysis', 'Dataset') AND {NUMERIC.format('text')} THEN 0.06e0 ELSE 0e0 END "
    f"- CASE WHEN list_has_any({TOKENS.format('text')}, {listed(HEDGES)}) THEN 0.08e0 ELSE 0e0 END AS score FROM raw JOIN s USING (doc_id, sent_idx) LEFT JOIN priors USING (section, label) LEFT JOIN bases USING (label)",
    "best": f"SELECT doc_id, sent_idx, arg_max(label, (score, -{TYPE_ORDER})) AS type, max(score) AS conf, coalesce(max(CASE WHEN label = 'Conclusion' THEN score END), 0e0) AS conclusion FROM scores GROUP BY ALL",
    "d0": f"SELECT s.doc_id, s.sent_idx, page, section, text, coalesce(conclusion, 0e0) AS conclusion, (section = 'REFERENCES' OR {reference('text')}) AS g, coalesce(type, '') AS t0, coalesce(conf, 0e0) AS c0, has_citation, citation_strength, is_caption AND caption_type IN ('Figure', 'Table') AS captioned, CASE WHEN is_caption AND caption_type IN ('Figure', 'Table') THEN caption_type || 'Caption' ELSE 'Body' END AS place FROM s LEFT JOIN best USING (doc_id, sent_idx)",
    "d1": "SELECT * EXCLUDE (t0, c0, g), CASE WHEN g THEN 'Other' ELSE t0 END AS type, CASE WHEN g THEN 0.39e0 ELSE c0 END AS conf FROM d0",
    "d2": f"SELECT * REPLACE (CASE WHEN type IN ('Input Fact', 'Result', 'Conclusion') THEN least(1e0, conf + least(0.12e0, 0.08e0 * round(CASE WHEN citation_strength > 0 THEN citation_strength ELSE {STRENGTH} END * 10) / 10)) ELSE conf END AS conf) FROM d1",
    "d2c": "SELECT * REPLACE (CASE WHEN has_citation AND type = 'Input Fact' THEN least(1e0, conf + 0.12e0) ELSE conf END AS conf) FROM d2",
    "d3": f"SELECT * REPLACE (CASE WHEN {HEAVY} THEN greatest(0e0, conf - 0.08e0) ELSE conf END AS conf) FROM d2c",
    "d4": "SELECT * REPLACE (CASE WHEN type = 'Input Fact' AND NOT has_citation AND conf < 0.42e0 THEN 'Other' ELSE type END AS type, CASE WHEN type = 'Input Fact' AND NOT has_citation AND conf < 0.42e0 THEN 0.39e0 ELSE conf END AS conf) FROM d3",
    "d5": "SELECT *, (type <> '' AND conf >= 0.4e0 AND section IN ('DISCUSSION', 'RESULTS') AND regexp_matches(trim(lower(text)), '^(these results|overall|in conclusion|in summary)') "
    "AND regexp_matches(lower(text), 'suggest|indicate|support|imply|show') AND conclusion >= conf * 0.9e0 AND type <> 'Conclusion') AS turns FROM d4",
    "d6": "SELECT * EXCLUDE (turns) REPLACE (CASE WHEN turns THEN 'Conclusion' ELSE type END AS type, CASE WHEN turns AND section = 'DISCUSSION' THEN greatest(conf, 0.52e0) ELSE conf END AS conf) FROM d5",
    "d6c": "SELECT * REPLACE (CASE WHEN captioned AND type IN ('Result', 'Analysis', 'Experiment', 'Dataset') THEN least(1e0, conf + 0.08e0) ELSE conf END AS conf) FROM d6",
    "d7": f"SELECT *, (type IN ('Other', 'Input Fact', 'Analysis') AND section = 'RESULTS' AND {NOTED}) AS pull FROM d6c",
    "d": "SELECT doc_id, sent_idx, page, section, text, place, CASE WHEN pull THEN 'Result' ELSE type END AS type, round(CASE WHEN pull THEN greatest(conf, 0.46e0) ELSE conf END, 3) AS conf FROM d7 WHERE CASE WHEN pull THEN greatest(conf, 0.46e0) ELSE conf END >= 0.4e0 AND type <> ''",
    "n0": f"SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) AS INTEGER) AS node_idx, {OUTCOME_TOKENS} AS tok, {EDGE_TOKENS} AS et, {REFS} AS refs FROM d",
    "n": f"SELECT * EXCLUDE (tok), replace(replace(CAST(doc_id AS VARCHAR), '/', '-'), ':', '-') || ':' || replace(type, ' ', '') || printf(':%04d', node_idx) AS id, {POLARITY} AS polarity FROM n0",
    "specs": f"SELECT * FROM (VALUES {LINK_ROWS}) v(st, dt, etype, ord, max_forward, max_k, max_page, min_conf, bonus)",
    "pairs": "SELECT a.doc_id, a.node_idx AS src, b.node_idx AS dst, st, dt, etype, ord, max_k, min_conf, bonus, b.sent_idx - a.sent_idx AS gap, abs(b.page - a.page) AS dp, a.conf AS ca, b.conf AS cb, a.polarity AS sp, "
    "a.section AS sa, b.section AS sb, lower(a.text) AS la, lower(b.text) AS lb, b.text AS tb, a.et AS ea, b.et AS eb, a.refs AS ra, b.refs AS rb "
    "FROM n a JOIN specs ON a.type = st JOIN n b ON a.doc_id = b.doc_id AND b.type = dt AND b.sent_idx > a.sent_idx AND b.sent_idx - a.sent_idx <= max_forward AND abs(b.page - a.page) <= max_page "
    f"WHERE a.section NOT IN ('REFERENCES', 'BIBLIOGRAPHY') AND b.section NOT IN ('REFERENCES', 'BIBLIOGRAPHY') AND CASE WHEN a.type = 'Experiment' AND b.type IN ('Result', 'Analysis', 'Conclusion') THEN b.section IN {LATE} "
    f"WHEN a.type = 'Result' AND b.type IN ('Result', 'Conclusion', 'Hypothesis') THEN b.section IN {LATE} "
    "WHEN a.type IN ('Technique', 'Dataset') AND b.type IN ('Experiment', 'Analysis') THEN b.section IN ('METHODS', 'MATERIALS AND METHODS', 'RESULTS', 'DISCUSSION', 'RESULTS AND DISCUSSION') ELSE true END",
    "cand": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord, src ORDER BY gap, dst) AS k FROM pairs) WHERE k <= max_k",
    "weighed": f"SELECT *, (least(0.04e0, len(list_intersect(ea, eb)) * 0.015e0) + CASE WHEN list_has_any(ra, rb) THEN 0.04e0 ELSE 0e0 END + "
    f"CASE WHEN st = 'Experiment' AND dt = 'Result' THEN CASE WHEN {NUMERIC.format('tb')} THEN 0.05e0 ELSE 0e0 END + CASE WHEN sa <> sb THEN 0.02e0 ELSE 0e0 END "
    f"WHEN st = 'Result' AND dt = 'Hypothesis' THEN CASE WHEN {inside('lb', CUES)} THEN 0.04e0 ELSE 0e0 END "
    f"WHEN st = 'Technique' AND dt = 'Result' THEN CASE WHEN {inside('la', ['method', 'protocol'])} THEN 0.02e0 ELSE 0e0 END "
    f"WHEN st = 'Dataset' AND dt = 'Result' THEN CASE WHEN {inside('lb', ['table', 'figure'])} THEN 0.02e0 ELSE 0e0 END - CASE WHEN {NUMERIC.format('tb')} THEN 0e0 ELSE 0.06e0 END ELSE 0e0 END) + bonus AS extra, "
    "greatest(greatest(0.4e0, least(0.7e0, 0.52e0 - (CASE WHEN gap <= 1 THEN 0.05e0 WHEN gap <= 2 THEN 0.03e0 ELSE 0e0 END + CASE WHEN dp = 0 THEN 0.02e0 ELSE 0e0 END) "
    "+ (CASE WHEN gap >= 8 THEN 0.04e0 ELSE 0e0 END + CASE WHEN dp >= 2 THEN 0.03e0 ELSE 0e0 END))), min_conf) AS least_conf, CASE WHEN ord = 4 AND sp = 'negative' THEN 'refutes' ELSE etype END AS kind FROM cand",
    "prox": "SELECT doc_id, src, dst, kind AS type, round(least(1e0, greatest(0e0, (ca + cb) / 2 + extra)), 3) AS conf, 'prox' AS hint FROM weighed WHERE least(1e0, greatest(0e0, (ca + cb) / 2 + extra)) >= least_conf",
    "cn": "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, gap, src, dst) AS nth, src, dst, ca, cb, extra, least_conf, kind FROM weighed",
    # One candidate of each document a round; now holds what accepted links made of the nodes' confidences.
    "fold": "SELECT doc_id, CAST(0 AS BIGINT) AS nth, MAP {}::MAP(INTEGER, DOUBLE) AS now, CAST(NULL AS INTEGER) AS src, CAST(NULL AS INTEGER) AS dst, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS DOUBLE) AS c, false AS hit FROM (SELECT DISTINCT doc_id FROM cn) "
    "UNION ALL SELECT doc_id, nth, CASE WHEN c >= least_conf THEN map_concat(now, MAP([src, dst], [least(1e0, a + 0.02e0), least(1e0, b + 0.02e0)])) ELSE now END, src, dst, kind, c, c >= least_conf FROM ("
    "SELECT cn.doc_id, cn.nth, fold.now, cn.src, cn.dst, cn.kind, least_conf, coalesce(fold.now[cn.src], ca) AS a, coalesce(fold.now[cn.dst], cb) AS b, least(1e0, greatest(0e0, (coalesce(fold.now[cn.src], ca) + coalesce(fold.now[cn.dst], cb)) / 2 + extra)) AS c "
    "FROM fold JOIN cn ON cn.doc_id = fold.doc_id AND cn.nth = fold.nth + 1)",
    "rein": "SELECT doc_id, src, dst, kind AS type, round(c, 3) AS conf, 'prox' AS hint, [0, nth, 0, 0] AS pos FROM fold WHERE hit",
    "lasts": "SELECT f.doc_id, unnest(map_entries(now)) AS en FROM fold f JOIN (SELECT doc_id, max(nth) AS nth FROM fold GROUP BY doc_id) USING (doc_id, nth)",
    "rn": "SELECT n.* REPLACE (coalesce(en.value, n.conf) AS conf) FROM n LEFT JOIN lasts ON n.doc_id = lasts.doc_id AND n.node_idx = en.key",
    "lspecs": f"SELECT * FROM (VALUES {LONG_ROWS}) v(st, dt, etype, from_secs, to_secs, bonus, min_conf, per_src, ord)",
    "lp": f"SELECT a.doc_id, a.node_idx AS src, b.node_idx AS dst, st, dt, etype, min_conf, per_src, ord, b.sent_idx - a.sent_idx AS gap, a.polarity AS sp, "
    f"greatest(0e0, least(1e0, (a.conf + b.conf) / 2 + bonus + CASE WHEN st = 'Experiment' AND {NUMERIC.format('b.text')} THEN 0.04e0 WHEN st = 'Result' AND {inside('lower(b.text)', CUES)} THEN 0.03e0 ELSE 0e0 END "
    "- CASE WHEN b.sent_idx - a.sent_idx > 12 THEN least(0.14e0, (b.sent_idx - a.sent_idx - 12) * 0.004e0) ELSE 0e0 END + least(0.03e0, len(list_intersect(a.et, b.et)) * 0.01e0))) AS c "
    "FROM rn a JOIN lspecs ON a.type = st AND list_contains(from_secs, a.section) JOIN rn b ON a.doc_id = b.doc_id AND b.type = dt AND list_contains(to_secs, b.section) AND b.sent_idx > a.sent_idx",
    "long": "SELECT doc_id, src, dst, CASE WHEN st = 'Result' AND sp = 'negative' THEN 'refutes' ELSE etype END AS type, round(c, 3) AS conf, 'longrange' AS hint, [1, ord, src, k] AS pos FROM ("
    "SELECT *, row_number() OVER (PARTITION BY doc_id, st, dt, src ORDER BY c DESC, gap, dst) AS k FROM lp WHERE c >= min_conf AND NOT EXISTS (SELECT 1 FROM rein p WHERE p.doc_id = lp.doc_id AND p.src = lp.src AND p.dst = lp.dst)) WHERE k <= per_src",
    "marks": "SELECT doc_id, node_idx, sent_idx, type, place, unnest(refs) AS ref FROM n",
    "fig": "SELECT doc_id, src, dst, CASE WHEN type IN ('Result', 'Conclusion') THEN 'summarizes' ELSE 'informs' END AS type, 0.6e0 AS conf, CASE WHEN starts_with(ref, 'F') THEN 'figure' ELSE 'table' END AS hint, [CASE WHEN starts_with(ref, 'F') THEN 2 ELSE 3 END, src, k, dst] AS pos FROM ("
    "SELECT a.doc_id, a.ref, a.node_idx AS src, b.node_idx AS dst, b.type, row_number() OVER (PARTITION BY a.doc_id, a.ref, a.node_idx ORDER BY b.sent_idx - a.sent_idx, b.node_idx) AS k "
    "FROM marks a JOIN marks b ON a.doc_id = b.doc_id AND a.ref = b.ref AND a.place <> 'Body' AND b.place = 'Body' AND b.sent_idx > a.sent_idx) WHERE k <= 3",
    "edges": "SELECT * FROM rein UNION ALL SELECT * FROM long UNION ALL SELECT * FROM fig",
    "nd0": "SELECT *, trim(lower(text)) AS lowered, CASE WHEN type = 'Hypothesis' THEN CASE WHEN contains(section, 'INTRO') THEN 'INTRO' WHEN contains(section, 'DISCUSSION') THEN 'DISCUSSION' ELSE 'OTHER' END ELSE '' END AS context FROM rn",
    "nd1": "SELECT *, regexp_replace(regexp_replace(lowered, '[“”\"''`]+', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g') AS norm FROM nd0",
    "nd": "SELECT doc_id, node_idx, sent_idx, page, section, text, type, conf, first_value(node_idx) OVER (PARTITION BY doc_id, type, norm, context ORDER BY conf DESC, node_idx) AS kept, count(*) OVER (PARTITION BY doc_id, type, norm, context) AS merged, "
    "CASE WHEN min(polarity) OVER (PARTITION BY doc_id, type, norm, context) <> max(polarity) OVER (PARTITION BY doc_id, type, norm, context) THEN 'neutral' ELSE polarity END AS polarity FROM nd1",
    "kn": "SELECT * EXCLUDE (kept) FROM nd WHERE kept = node_idx",
    "rm": "SELECT x.doc_id, a.kept AS src, b.kept AS dst, x.type, x.conf, x.hint, x.pos, a.type AS st, b.type AS dt, a.polarity AS sp, b.polarity AS dp FROM edges x JOIN nd a ON x.doc_id = a.doc_id AND x.src = a.node_idx JOIN nd b ON x.doc_id = b.doc_id AND x.dst = b.node_idx",
    "al": f"SELECT * FROM (VALUES {ALLOWED_ROWS}) v(st, dt, kinds, dflt)",
    "rl0": "SELECT rm.*, kinds, CASE WHEN rm.st = 'Result' AND rm.dt = 'Hypothesis' AND (sp = 'negative' OR dp = 'negative') THEN 'refutes' ELSE dflt END AS fallback FROM rm JOIN al ON rm.st = al.st AND rm.dt = al.dt",
    "rl": "SELECT doc_id, src, dst, CASE WHEN list_contains(kinds, type) THEN type ELSE fallback END AS type, conf, CASE WHEN list_contains(kinds, type) THEN hint ELSE hint || ';retyped' END AS hint, pos, st, dt FROM rl0 WHERE list_contains(kinds, type) OR list_contains(kinds, fallback)",
    "ea": "SELECT doc_id, src, dst, type, max(conf) AS conf, arg_min(hint, (-conf, pos)) AS hint, min(pos) AS pos FROM rl GROUP BY ALL",
    "first2": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY node_idx) AS k FROM kn) WHERE k <= 2",
    "bb": "SELECT a.doc_id, a.node_idx AS src, b.node_idx AS dst, CASE WHEN etype = 'supports' AND a.polarity = 'negative' THEN 'refutes' ELSE etype END AS type, 0.56e0 AS conf, 'fallback' AS hint, [9, a.node_idx, b.node_idx, 0] AS pos "
    f"FROM first2 a JOIN (VALUES {BACKBONE_ROWS}) v(st, dt, etype) ON a.type = st JOIN first2 b ON a.doc_id = b.doc_id AND b.type = dt",
    "ab": "SELECT * FROM ea UNION ALL SELECT * FROM bb WHERE doc_id NOT IN (SELECT doc_id FROM ea)",
    "strong": "SELECT * FROM ea WHERE conf >= 0.55e0",
    "ed": "SELECT * FROM strong UNION ALL SELECT * FROM bb WHERE doc_id NOT IN (SELECT doc_id FROM strong)",
    "ends": "SELECT doc_id, count(DISTINCT x) AS touched FROM (SELECT doc_id, unnest([src, dst]) AS x FROM ab) GROUP BY doc_id",
    "co": "SELECT k.doc_id, count(*) AS nodes, count(CASE WHEN type = 'Hypothesis' THEN 1 END) AS hypotheses, count(CASE WHEN type = 'Result' THEN 1 END) AS results FROM kn k GROUP BY k.doc_id",
    "coh": "SELECT co.*, coalesce(touched, 0) AS touched, CAST(coalesce(touched, 0) AS DOUBLE) / nodes AS coherence FROM co LEFT JOIN ends USING (doc_id)",
}
ORDER = list(CTE)


#: Sentences of a corpus of TEI files, as catalog._tei makes them of the documents' sentences, in place of the sentences themselves.
INLINE = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '[ \\t ]+', ' ', 'g'), ' +([),.;:}}]|\\])', '\\1', 'g'), '([(\\[{{]) +', '\\1', 'g'), "
    "'([a-z])(Figure|Table)', '\\1 \\2', 'g'), '([0-9]%)of', '\\1 of', 'g'))"
)
_STRIPPED = "regexp_replace({0}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"
_YEARED = "'\\(\\s*[A-Z][A-Za-z''’-]+(\\s+et\\s+al\\.)?(\\s*,\\s*((18|19|20|21)[0-9]{2}))(\\s*[,;]\\s*[A-Z][A-Za-z''’-]+(\\s+et\\s+al\\.)?\\s*,\\s*((18|19|20|21)[0-9]{2}))*\\s*\\)'"
_NONE = "'(?i)\\([^)]{0,6}(n\\s*=\\s*[0-9]+|p\\s*[<≤=]\\s*0?\\.[0-9]+|CI\\s*[0-9]{1,3}\\s*%|Fig\\.?\\s*[0-9]+|Table\\s*[0-9]+|Eq\\.?\\s*[0-9]+)[^)]{0,20}\\)'"
TEI = {
    "plain": CTE["s"],
    "te": "SELECT doc_id, sent_idx AS i, page, CASE sent_idx % 11 WHEN 3 THEN 'Figure' WHEN 6 THEN 'Table' ELSE '' END AS kind, regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g') AS c FROM plain",
    "tt": "SELECT *, CASE kind WHEN 'Figure' THEN 'Figure ' || (i % 5 + 1) || '. ' || c WHEN 'Table' THEN 'Table ' || (i % 3 + 1) || '. ' || c "
    "ELSE c || CASE i % 11 WHEN 4 THEN ' (Fig. ' || ((i - 1) % 5 + 1) || ')' WHEN 8 THEN ' in Table ' || ((i - 2) % 3 + 1) ELSE '' END || CASE i % 9 WHEN 2 THEN ' [3, 7]' WHEN 5 THEN ' (Smith et al., 2019)' ELSE '' END END AS body FROM te",
    "tc": f"SELECT *, {INLINE.format(_STRIPPED.format('body'))} AS text FROM tt",
    "tf": f"SELECT *, CASE WHEN regexp_matches(text, {_YEARED}) AND NOT regexp_matches(text, {_NONE}) AND (nullif(regexp_extract(text, {_YEARED}, 3), '') IS NULL OR CAST(nullif(regexp_extract(text, {_YEARED}, 3), '') AS INTEGER) BETWEEN 1800 AND 2027) "
    f"AND (nullif(regexp_extract(text, {_YEARED}, 7), '') IS NULL OR CAST(nullif(regexp_extract(text, {_YEARED}, 7), '') AS INTEGER) BETWEEN 1800 AND 2027) THEN 0.7e0 "
    "WHEN regexp_matches(text, '(^|[^A-Za-z])\\[\\s*[0-9]{1,3}(\\s*[-–,;]\\s*[0-9]{1,3}){0,6}\\]') THEN 0.5e0 ELSE 0e0 END AS citation_strength FROM tc WHERE text <> ''",
    "s": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS sent_idx, text, page, CASE WHEN i % 13 = 5 AND kind = '' THEN 'ABSTRACT' WHEN i // 7 % 4 = 0 THEN 'INTRO' WHEN i // 7 % 4 = 1 THEN 'METHODS' ELSE 'DISCUSSION' END AS section, "
    "citation_strength > 0 AS has_citation, citation_strength, kind <> '' AS is_caption, kind AS caption_type, CASE kind WHEN 'Figure' THEN 10e0 WHEN 'Table' THEN 1e0 ELSE i END AS x0, CASE kind WHEN 'Figure' THEN 20e0 WHEN 'Table' THEN 2e0 ELSE 10e0 END AS y0, "
    "CASE kind WHEN 'Figure' THEN 40e0 WHEN 'Table' THEN 4e0 ELSE i + 60e0 END AS x1, CASE kind WHEN 'Figure' THEN 60e0 WHEN 'Table' THEN 6e0 ELSE 42e0 END AS y1 FROM tf",
}


def sql(select: str, *last: str, tei: bool = False) -> str:
    """select, with all expressions up to the last one that it names; tei: over the TEI corpus."""
    upto = max(ORDER.index(x) for x in last)
    wanted = {k: CTE[k] for k in ORDER[: upto + 1]}
    if tei:
        wanted = {k: v for k, v in CTE.items() if k in ("parts", "cut")} | TEI | {k: v for k, v in wanted.items() if k not in ("parts", "cut", "s")}
    kept = {"s", "d", "n", "cn", "rn", "rein", "kn", "ea", "bb"}  # read several times
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS {'MATERIALIZED ' if k in kept else ''}({v})" for k, v in wanted.items()) + "\n" + select
