"""Patterns, scorer, regex rules, lint, LaTeX, layout and refinement on small literal inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import labeler as L
from quillgraph.operators import patterns as P
from quillgraph.operators import refine as RF
from quillgraph.operators import regexrules as Q
from quillgraph.plans import lint
from quillgraph.sources import latex, layout

SENTENCE = "doc_id long, sent_idx int, section string, text string"


def brute_spans(steps, tokens):
    """Every span that some choice of repeats reads, tried one by one."""
    out = set()
    for start in range(len(tokens)):
        for end in range(start + 1, len(tokens) + 1):
            n = end - start
            ranges = [range(0, 2) if op == "?" else range(0, n + 1) if op == "*" else range(1, n + 1) if op == "+" else [1] for _, op in steps]
            for counts in itertools.product(*ranges):
                if sum(counts) == n:
                    want = [s for s, c in zip(steps, counts) for _ in range(c)]
                    if all((t == w) != (op == "!") for t, (w, op) in zip(tokens[start:end], want)):
                        out.add((start, end))
    return out


def test_patterns_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        steps = [(rng.choice("ab"), rng.choice(["1", "1", "?", "+", "*", "!"])) for _ in range(rng.randint(1, 3))]
        tokens = [rng.choice("abc") for _ in range(rng.randint(0, 5))]
        pattern = [{"LOWER": w} | ({} if op == "1" else {"OP": op}) for w, op in steps]
        got = {(a, b) for _, a, b in P.Matcher([{"name": "r", "label": "Result", "patterns": [pattern]}]).spans(tokens)}
        assert got == brute_spans(steps, tokens), (steps, tokens)


def test_pattern_attributes():
    def holds(step, token):
        return bool(P.Matcher([{"name": "r", "label": "x", "patterns": [[step]]}]).spans([token]))

    assert holds({"LEMMA": {"IN": ["improve"]}}, "Improved") and not holds({"LEMMA": "improve"}, "improver")
    assert holds({"LIKE_NUM": True}, "twelve") and holds({"LIKE_NUM": True}, "0.05") and not holds({"LIKE_NUM": True}, "x1")
    assert holds({"TEXT": {"REGEX": "^p"}}, "pH") and holds({"LOWER": {"NOT_IN": ["a"]}}, "b") and holds({"IS_TITLE": True, "IS_ALPHA": True}, "Methods")
    pack = [{"name": "r", "label": "x", "patterns": [[{"POS": "VERB"}], [{"LOWER": "a"}]]}]
    assert P.unsupported(pack) == [("r", 0)]


def test_pattern_sections_and_nulls(spark, tmp_path):
    rows = [(1, 0, "METHODS", "run with the probe"), (1, 1, "INTRO", "run with the probe"), (1, 2, None, None), (1, 3, "METHODS", "")]
    hits = P.pattern_hits(spark.createDataFrame(rows, SENTENCE), L.PACK).collect()
    assert {(r["sent_idx"], r["rule"], r["start"], r["end"]) for r in hits} == {(0, "TEC_USING", 1, 2), (0, "TEC_USING", 1, 3)}
    (tmp_path / "pack.json").write_text('[{"name": "A", "label": "Result", "patterns": []}]')
    assert P.load_pack(spark, str(tmp_path / "pack.json"))[0]["name"] == "A"


@pytest.mark.parametrize(
    "section, text, cited, rules, label",
    [
        ("METHODS", "plain", False, {}, "OTHER"),
        ("RESULTS", "plain", False, {}, "Result"),
        ("REFERENCES", "plain", False, {"RES_STATS": 1}, "OTHER"),
        ("INTRO", "plain", True, {}, "Input Fact"),
        ("METHODS", "plain", False, {"TEC_USING": 1}, "Technique"),
        ("METHODS", "plain", False, {"TEC_USING": 3, "ANA_SURFACE": 1}, "Analysis"),
        ("RESULTS", "significant", False, {"DATA_SURFACE": 5}, "Result"),
        ("INTRO", "plain", False, {"HYP_SURFACE": 1}, "Hypothesis"),
        ("OTHER", "plain", False, {"INF_CIT_DOI": 1}, "OTHER"),
        ("OTHER", "see vol 3", False, {"RES_STATS": 1}, "OTHER"),
    ],
)
def test_labels(spark, section, text, cited, rules, label):
    pack = L.PACK + [{"name": "INF_CIT_DOI", "label": "Input Fact", "patterns": []}]
    s = spark.createDataFrame([(1, 0, section, text, cited)], SENTENCE + ", has_citation boolean")
    counts = spark.createDataFrame([(1, 0, r, n) for r, n in rules.items()], "doc_id long, sent_idx int, rule string, hits long")
    assert L.labelled(s, counts, pack).first()["label"] == label


def test_regex_rules(spark):
    rows = [(1, 0, "RESULTS", "3 of them"), (1, 1, "RESULTS", "3 of them did not"), (1, 2, "INTRO", "3 of them"), (1, 3, "INTRO", "With the probe"), (1, 4, None, None)]
    s = spark.createDataFrame(rows, SENTENCE)
    assert {(r["sent_idx"], r["rule"]) for r in Q.regex_hits(s, Q.RULES).collect()} == {(0, "plain/Result/count"), (3, "plain/Technique/with")}
    assert Q.regex_hits(s, []).count() == 0
    d = spark.createDataFrame([(1, "the and in"), (2, "de la und der"), (3, None), (4, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["theme"], r["rank"]) for r in Q.theme_scores(d, Q.TRIGGERS).orderBy("doc_id", "rank").collect()] == [(1, "prose", 1), (2, "romance", 1), (2, "german", 2)]


def test_lint(spark, tmp_path):
    bad = {"elements": [{"id": "a", "type": "Result", "weight": 0.5, "sections": ["Results"], "pattern": "x"}, {"id": "a", "type": "Nope", "weight": 2, "sections": [], "pattern": "(", "captures": [""]}, 3]}
    issues = lint.linted(spark, [("f", "rules", bad), ("t", "triggers", {"should": [["a"]], "topk": 0}), ("l", "lexicon", {"abbr": [["a"]]}), ("n", "rules", None)])
    got = {(r["path"], r["where"]) for r in issues.where("kind = 'ERROR'").collect()}
    second = {("f", f"elements[1].{x}") for x in ("id", "type", "sections", "pattern", "captures[0]")}
    assert got == second | {("f", "elements[2]"), ("t", "name"), ("t", "should[0]"), ("t", "topk"), ("l", "abbr[0]"), ("n", "file")}
    assert not lint.passes(issues) and lint.passes(lint.linted(spark, []), strict=True)
    assert lint.exit_code(spark, str(tmp_path)) == 2
    (tmp_path / "themes" / "x").mkdir(parents=True)
    (tmp_path / "themes" / "x" / "triggers.yaml").write_text("name: x\nmust: [a]\n")
    assert lint.exit_code(spark, str(tmp_path)) == 0 and lint.exit_code(spark, str(tmp_path), strict=True, report=str(tmp_path / "r.json")) == 2
    assert "no version" in (tmp_path / "r.json").read_text()


@pytest.mark.parametrize("pattern, n", [("a.*b", 1), ("a.*?b", 0), ("a.{0,9}b", 0), ("(?:.*)+", 2), ("(a+)*", 1), ("[a++]", 0), ("(x|y)z", 0), ("(", 1), (None, 0)])
def test_doubtful_patterns(pattern, n):
    assert len(lint.doubts(pattern)) == n


TEX = r"""\documentclass{x} % comment
\begin{document}
\begin{abstract}We show \textbf{much} $x^2$.\end{abstract}
\section{METHODS} Used 5\% of it \cite{a}.
\subsection{Probe} Text with
a break. \begin{figure}\includegraphics[w=1]{a.png}\caption{A {nested} one \label{inner}}\label{fig:a}\end{figure}
\subsection{Empty}
\section{Results} It grew. \begin{table*}\caption{Numbers}\end{table*} \captionof{figure}{Loose}
\end{document}"""


def test_latex(spark):
    src = spark.createDataFrame([("p", TEX), ("q", "No headings."), ("r", ""), ("s", None)], "root string, text string")
    got = [(r["root"], r["heading"], r["name"], r["title_path"]) for r in latex.sections(src).orderBy("root", "pos").collect()]
    assert got == [("p", "Abstract", "Abstract", "Abstract"), ("p", "Methods", "Methods", "Methods"), ("p", "Probe", "Methods", "Methods > Probe"), ("p", "Results", "Results", "Results"), ("q", "Body", "Body", "Body")]
    texts = {r["heading"]: r["text"] for r in latex.sections(src).collect()}
    assert texts["Abstract"] == "We show much ." and texts["Methods"].startswith("Used 5 % of it")
    caps = [(r["id"], r["kind"], r["text"], r["graphics"]) for r in latex.captions(src).orderBy("pos").collect()]
    assert caps == [("fig:a", "Figure", "A nested one inner", ["a.png"]), ("Table1", "Table", "Numbers", []), ("Figure1", "Figure", "Loose", [])]


def test_latex_includes(spark):
    body = "\\begin{document}\\input{sec/a}\\include{missing}\\end{document}"
    files = [("p", "x/other.tex", body), ("p", "main.tex", body), ("p", "sec/a.tex", "A \\input{b}"), ("p", "sec/b.tex", "B \\input{a}"), ("q", "z.tex", "plain"), ("q", "b.tex", "first")]
    df = spark.createDataFrame(files, "root string, path string, text string")
    assert {r["root"]: r["path"] for r in latex.main_files(df).collect()} == {"p": "main.tex", "q": "b.tex"}
    got = {r["root"]: r["text"].split() for r in latex.expanded(df).collect()}
    assert got["p"] == ["\\begin{document}", "A", "B", "\\end{document}"] and got["q"] == ["first"]
    meta = latex.metadata(spark.createDataFrame([("p", "\\title{A \\emph{b}}\\author{X \\and Y}")], "root string, text string")).first()
    assert (meta["title"], meta["author"], meta["date"]) == ("A b", "X , Y", None)


def test_layout(spark):
    lines = [("d", 0, 0, "A Title", 20.0, 10.0, 10.0, 50.0, 20.0), ("d", 0, 1, "X Y", 12.0, 10.0, 30.0, 50.0, 40.0), ("d", 0, 2, "1. Methods", 10.0, 10.0, 50.0, 50.0, 60.0), ("d", 0, 3, "We ran it.", 9.0, 10.0, 70.0, 50.0, 80.0), ("d", 1, 4, "Figure 2: The probe", 9.0, 10.0, 300.0, 50.0, 310.0), ("d", 1, 5, "Fig. 3 Other", 9.0, 10.0, 320.0, 50.0, 330.0)]
    df = spark.createDataFrame(lines, "doc_id string, page int, line int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    assert tuple(layout.title_and_authors(df).first()) == ("d", "A Title", "X Y")
    rows = layout.sections(df, "doc_id", ["page", "line"], layout.is_heading(F.col("text"))).orderBy("section").collect()
    assert [(r["heading"], r["page_start"], r["page_end"]) for r in rows] == [("Body", 0, 0), ("1. Methods", 0, 1)]
    caps = layout.captions(df)
    assert {(r["id"], r["body"]) for r in caps.collect()} == {("Figure2", "The probe"), ("Figure3", "Other")}
    images = spark.createDataFrame([("d", 1, 0, 10.0, 100.0, 50.0, 290.0), ("d", 1, 1, 300.0, 0.0, 350.0, 50.0)], "doc_id string, page int, image int, x0 double, y0 double, x1 double, y1 double")
    assert {(r["line"], r["image"]) for r in layout.caption_images(caps, images).collect()} == {(4, 0), (5, None)}


@pytest.mark.parametrize(
    "answer, found",
    [('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ('so: {"a": {"b": "x}"', {"a": {"b": "x}"}}), ('{"a": [1', {"a": [1]}), ("none", None), (None, None), ('{"a" 1}', None), ('{"a": "\\"]"} {', {"a": '"]'})],
)
def test_repaired(answer, found):
    assert RF.repaired(answer) == found


def test_refine(spark):
    nodes = spark.createDataFrame([(1, 1, 0, 0, "METHODS", "ran", "Experiment", 0.9, "neutral"), (1, 2, 1, 0, "RESULTS", "fell", "Result", 0.8, "neutral")], "doc_id long, node_idx int, sent_idx int, page int, section string, text string, type string, conf double, polarity string")
    edges = spark.createDataFrame([], "doc_id long, src int, dst int, type string, conf double, hint string")
    asked = RF.prompts(nodes, edges)
    empty = spark.createDataFrame([], "key string, answer string, ts long")
    answer = '{"edges": [{"from": 1, "to": 2, "type": "produces", "conf": 0.7}, {"from": 2, "to": 1, "type": "produces"}, {"from": 1, "to": 9, "type": "produces"}, {"from": 1}, 3'
    cache = RF.answered(asked, empty, lambda prompt: answer)
    got = RF.merged(spark, nodes, edges, RF.proposed(asked, cache)).collect()
    assert [(r["src"], r["dst"], r["type"], r["hint"]) for r in got] == [(1, 2, "produces", "llm")]
    assert RF.answered(asked, cache, lambda prompt: answer).count() == 0
    assert RF.answered(asked, empty, lambda prompt: 1 / 0).count() == 0


def test_boxes_and_names(spark):
    row = spark.createDataFrame([("1,10,20,30,40;p1,5,50,10,10;2,0,0,1,1;bad",), ("",), (None,)], "c string").select(X.union_box(X.boxes(F.col("c"))).alias("b"), F.size(X.boxes(F.col("c"))).alias("n")).collect()
    assert tuple(row[0]["b"]) == (1, 5.0, 20.0, 40.0, 60.0) and [r["n"] for r in row] == [3, 0, 0] and row[1]["b"]["page"] is None
    one = lambda f, v: spark.createDataFrame([(v,)], "v string").select(f(F.col("v"))).first()[0]
    assert one(X.slug, " A Title! ") == "a-title" and one(X.slug, "--") == "x"
    assert one(X.theme_list, "Bio; auto,bio,,x") == ["common", "bio", "x"]
    assert one(X.join_lines, "hyphen-\nated 3\n5 one\ntwo\n\nnew") == "hyphenated 3.5 one two\n\nnew"
    assert one(X.listed_items, "Aims: (1) to see, (2) to do") and not one(X.listed_items, "Smith (3) and Jones (4)")
