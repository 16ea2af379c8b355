"""The document-graph engine on small literal inputs; the SQL side is held at sf0.001."""

import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgraph import catalog
from quillgraph.functions import text as X
from quillgraph.operators import edges as E
from quillgraph.operators import graph as G
from quillgraph.operators import nodes as N
from quillgraph.plans import dims
from quillgraph.sources import files, tei
from quillgraph.sources import readers as R
from quillgraph.streaming import jobs

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, strength", [("seen before (Smith, 2019).", 0.7), ("Prior evidence is limited [3, 7].", 0.5), ("a group (n = 120) [4]", 0.5), ("a group (n = 120)", 0.0), ("plain", 0.0)])
def test_citation_strength(spark, text, strength):
    assert one(spark, text, X.citation_strength) == strength


def test_reference_guard(spark):
    assert one(spark, "Smith J. Journal of Pain, vol 3, pp 12-19, 2019.", X.looks_like_reference)
    assert not one(spark, "vol 3", X.looks_like_reference)


@pytest.mark.parametrize("text, outcome", [("The difference was not significant.", "negative"), ("pain decreased", "negative"), ("no decrease was seen", "neutral"), ("no decrease, and others fail", "neutral"), ("we improved it", "positive"), ("nothing here", "neutral")])
def test_polarity(spark, text, outcome):
    assert one(spark, text, X.polarity) == outcome


def test_threshold_bounds(spark):
    rows = [(1, 0), (2, 0), (5, 1), (8, 2), (30, 3)]
    got = [round(r["x"], 3) for r in spark.createDataFrame(rows, "g int, p int").select(E.threshold(F.col("g"), F.col("p")).alias("x")).collect()]
    assert got == [0.45, 0.47, 0.52, 0.59, 0.59]


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>On  it</title><author><persName>A B</persName></author><author>C</author></titleStmt>
<publicationStmt><date>2020</date></publicationStmt></fileDesc><idno type="x">none</idno></teiHeader><text><abstract><s coords="2,1,2,3,4">One ( 1 ) .</s></abstract><body><head coords="1,0,0,5,5">1. Introduction</head>
<s coords="p1,10,20,5,5;p2,0,0,1,1">Two <ref target="#b1">x</ref> (Smith et al., 2019).</s><s>A[3] is no mark</s><s>Many (Smith, 2999) said</s><s> </s><head>2 Methods</head>
<figure coords="1,1,1,9,9"><head>Methods and more</head><figDesc coords="1,0,0,2,2">Figure 1. Seen in 60%of [3, 7]</figDesc></figure><table coords="1,5,5,1,1"><head coords="1,4,4,1,1">Table 2. Sums (n = 3)</head></table><table/></body>
<ptr target="https://arxiv.org/abs/2101.00001v2"/></text></TEI>"""


def test_tei(spark):
    files = spark.createDataFrame([("/a/My paper!.pdf", TEI), ("b", "<broken"), ("/c/x y.tei", "<TEI><s>Hi <ref type='bibr'>z</ref><ref target='#b0'>[1]</ref></s></TEI>")], "path string, tei string")
    docs, found = tei.documents(files, 2027)
    rows = {(r["path"], r["sent_idx"]): r for r in found.collect()}
    mine = [rows["/a/My paper!.pdf", i] for i in range(6)]
    assert [r["text"] for r in mine] == ["One (1).", "Two x (Smith et al., 2019).", "A[3] is no mark", "Many (Smith, 2999) said", "Figure 1. Seen in 60% of [3, 7]", "Table 2. Sums (n = 3)"]
    assert [(r["section"], r["page"], r["caption_type"], r["citation_strength"]) for r in mine] == [
        ("ABSTRACT", 1, "", 0.0), ("INTRO", 0, "", 0.7), ("INTRO", 0, "", 0.0), ("INTRO", 0, "", 0.0), ("METHODS", 0, "Figure", 0.5), ("METHODS", 0, "Table", 0.0)
    ]
    assert [tuple(mine[i][c] for c in ("x0", "y0", "x1", "y1")) for i in (1, 4, 5)] == [(10, 20, 15, 25), (0, 0, 10, 10), (4, 4, 6, 6)]
    assert rows["/c/x y.tei", 0]["citation_strength"] == 1.0
    meta = {r["path"]: r for r in docs.collect()}
    a = meta["/a/My paper!.pdf"]
    assert (a["doc_id"], a["title"], a["author"], a["created"], a["page_count"]) == ("2101.00001v2", "On  it", "A B, C", "2020", 2)
    assert meta["b"]["error"] and meta["b"]["page_count"] == 0 and meta["/c/x y.tei"]["doc_id"] == "x-y"
    flat = tei.sentences(tei.elements(files), 2027, drop_flat_heads=True).where("text = 'A[3] is no mark'").first()
    assert flat["section"] == "OTHER"


@pytest.mark.parametrize("text, outcome", [
    ("It did not improve.", "neutral"), ("A increased and B decreased.", "neutral"), ("They never fail.", "neutral"), ("It didn't decrease but others fail", "neutral"), ("The test failed", "negative"), ("null result, shows", "neutral"),
])
def test_outcomes_under_negation(spark, text, outcome):
    assert one(spark, text, X.polarity) == outcome


def test_notes_and_references_at_word_bounds(spark):
    assert not one(spark, "standby 3 units", lambda c: c.rlike(X.NUMERIC_HINT)) and one(spark, "rose by 3.5, p < 0.05", lambda c: c.rlike(X.NUMERIC_HINT))
    assert one(spark, "as in Smith et al.2019 and many more of them", X.looks_like_reference) and not one(spark, "as Smith et al. say and many more of them do", X.looks_like_reference)
    assert one(spark, "data:", X.normalize_type) == "Dataset" and one(spark, "HYP", X.normalize_type) == "Hypothesis" and one(spark, "inputfact", X.canon_type) == "Input Fact"
    assert sorted(one(spark, "Fig. 2, fig 3, Figure iv and Table 2", X.references)) == ["F2", "FIV", "T2"]


def test_decisions_with_captions_and_marked_citations(spark):
    cols = "doc_id long, sent_idx int, page int, section string, text string, has_citation boolean, citation_strength double, is_caption boolean, caption_type string"
    rows = [(1, 0, 0, "RESULTS", "the and", None, None, True, "Figure"), (1, 1, 0, "RESULTS", "the and", False, 0.0, False, ""), (1, 2, 0, "INTRO", "in it", True, 1.0, False, ""), (1, 3, 0, "RESULTS", "we saw, vol 3, that it rose by 30%", False, 0.0, False, "")]
    got = {r["sent_idx"]: (r["place"], r["type"], r["conf"]) for r in N.decisions(spark.createDataFrame(rows, cols)).collect()}
    assert got[0] == ("FigureCaption", "Result", 1.0) and got[1] == ("Body", "Result", 1.0) and got[2] == ("Body", "Input Fact", 1.0) and got[3] == ("Body", "Result", 0.46)


def test_themes(spark):
    rows = [(1, i, "INTRO" if i < 2 else "METHODS", t) for i, t in enumerate(["Alpha x", "beta", "alpha beta", "alpha", "alpha"])] + [(2, 0, "INTRO", "none")]
    registry = {"common": {"any": ["."]}, "a": {"any": ["alpha"], "methods_bias": ["beta"]}, "b": {"intro_bias": ["beta", "x"]}, "c": {}}
    got = {(r["doc_id"], r["theme"]): (r["score"], r["rank"]) for r in N.themes(spark.createDataFrame(rows, "doc_id long, sent_idx int, section string, text string"), registry).collect()}
    assert got == {(1, "a"): (7, 1), (1, "b"): (2, 2)}


def test_safe_links(spark):
    rows = [(1, 1, "Result", 0.7, "negative"), (1, 2, "Result", 0.7, "neutral"), (1, 3, "Hypothesis", 0.65, "neutral"), (1, 4, "Technique", 0.6, "neutral"), (2, 1, "Hypothesis", 0.9, "neutral"), (2, 2, "Technique", 0.9, "neutral"), (3, 1, "Result", 0.9, "neutral")]
    nodes = spark.createDataFrame(rows, "doc_id long, node_idx int, type string, conf double, polarity string")
    got = {tuple(r) for r in E.safe_links(nodes, spark.createDataFrame([(3,)], "doc_id long")).collect()}
    assert got == {(1, 1, 3, "refutes", 0.675), (1, 4, 1, "uses", 0.65), (2, 2, 1, "uses", 0.9)}


def test_figure_links(spark):
    rows = [(1, i, i, "Result" if i == 3 else "Dataset", "FigureCaption" if i == 0 else "Body", "Figure 1 and Table 2" if i % 2 == 0 else "see Fig. 1") for i in range(6)]
    nodes = spark.createDataFrame(rows, "doc_id long, node_idx int, sent_idx int, type string, place string, text string")
    got = {(r["src"], r["dst"], r["type"], r["hint"]) for r in E.figure_edges(nodes).collect()}
    assert got == {(0, 1, "informs", "figure"), (0, 2, "informs", "figure"), (0, 3, "summarizes", "figure"), (0, 2, "informs", "table"), (0, 4, "informs", "table")}


def test_reinforcement_against_a_plain_fold(spark):
    r = random.Random(3)
    rows = [(d, r.randrange(1, 5), r.randrange(1, 9), a, b, round(r.uniform(0.5, 1.05), 3), round(r.uniform(0.4, 0.99), 3), r.choice([0.0, 0.04]), round(r.uniform(0.4, 0.8), 2), "t") for d in (1, 2) for a in range(6) for b in range(6, 10)]
    own = {}
    rows = [(d, o, g, a, b, own.setdefault((d, a), ca), own.setdefault((d, b), cb), e, least, t) for d, o, g, a, b, ca, cb, e, least, t in rows]
    want, conf = set(), dict(own)
    for d, o, g, a, b, _, _, e, least, t in sorted(rows, key=lambda x: x[:5]):
        c = min(1.0, max(0.0, (conf[d, a] + conf[d, b]) / 2 + e))
        if c >= least:
            want.add((d, a, b, round(c, 9)))
            for n in (a, b):
                conf[d, n] = min(1.0, conf[d, n] + 0.02)
    found = E.reinforced(spark.createDataFrame(rows, "doc_id long, ord int, gap int, src int, dst int, ca double, cb double, extra double, least double, type string")).collect()
    assert {(x["doc_id"], x["src"], x["dst"], round(x["conf"], 9)) for x in found if x["dst"] is not None} == want
    assert all(math.isclose(x["conf"], conf[x["doc_id"], x["src"]]) for x in found if x["dst"] is None)


def test_files_and_lookups(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("x.pdf", "a/y.pdf", "a/z.txt"):
        (tmp_path / name).write_text("1")
    got = files.listed(spark, str(tmp_path), most=1).collect()
    assert len(got) == 1 and got[0]["total"] == 2
    assert files.inside("/in", "a/../b") == "/in/b" and files.inside("/in", "../etc") is None and files.inside("/in", "/etc") is None and files.inside("/in", "") == "/in"
    (tmp_path / "a" / "triggers.json").write_text('{"any": ["x"]}')
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "triggers.json").write_text("{")
    assert files.registry(spark, str(tmp_path)) == {"a": {"any": ["x"]}, "b": {}}
    assert [r["v"] for r in files.merged_packs({"common": [{"name": "r", "v": 1}, {"name": "q", "v": 2}], "a": [{"name": "r", "v": 3}]}, ["a", "none"])] == [3, 2]
    made = spark.createDataFrame([(2018, "c"), (1, "d")], "n long, category string").select("category", F.format_string("%04d--2017__t.pdf", "n").alias("name"))
    assert {(r["category"], r["year"]) for r in files.missing_years(made, [2017, 2018]).collect()} == {("c", 2017), ("d", 2017), ("d", 2018)}
    assert spark.range(1).select(files.year_candidates(F.lit(2020)).alias("y")).first()["y"] == [2020, 2019, 2021, 2018, 2022]
    graph = spark.createDataFrame([(1, 2), (7, 3)], "doc_id long, src long")
    files.write_by_document(graph, str(tmp_path / "g"))
    assert [r["src"] for r in files.of_document(spark, str(tmp_path / "g"), 7, graph.schema).collect()] == [3]


def test_reports_in_every_form(spark):
    t = spark.createDataFrame([(1, "INTRO", "Result", "supports", "R<1", 2)], "doc_id long, section string, type string, edge string, rule string, hits long")
    report = G.tallies(t.select("doc_id", "type"), t.select("doc_id", F.col("edge").alias("type")), t.select("doc_id", "rule", "hits"), t.select("doc_id", "section"))
    assert "## nodes: 1\n- Result: 1\n" in G.report_markdown(report).first()["report"] and "R&lt;1: 2" in G.report_html(report).first()["report"]
    assert '"rules":[{"name":"R<1","n":2}]' in G.report_json(report).first()["report"]


NODES = "doc_id long, node_idx int, sent_idx int, page int, section string, text string, type string, conf double, polarity string"


def test_links_and_dedup(spark):
    rows = [
        (1, 1, 0, 0, "METHODS", "We use alpha probes", "Technique", 0.9, "neutral"),
        (1, 2, 1, 0, "METHODS", "alpha probes were run", "Experiment", 0.9, "neutral"),
        (1, 3, 3, 0, "RESULTS", "It fell by 3%", "Result", 0.9, "negative"),
        (1, 4, 4, 0, "RESULTS", "it  fell by 3%", "Result", 0.8, "neutral"),
    ]
    nodes = spark.createDataFrame(rows, NODES)
    candidates = E.proximity_candidates(spark, E.features(nodes))
    near = E.proximity_edges(candidates)
    assert {(r["src"], r["dst"], r["type"]) for r in near.collect()} == {(1, 2, "uses"), (1, 3, "uses"), (1, 4, "uses"), (2, 3, "produces"), (2, 4, "produces"), (3, 4, "follows")}
    dedup = G.node_dedup(nodes)
    assert [(r["node_idx"], r["kept"], r["polarity"]) for r in dedup.orderBy("node_idx").collect()][2:] == [(3, 3, "neutral"), (4, 3, "neutral")]
    edges = G.edge_dedup(G.relinked(spark, G.remapped(near.withColumn("pos", F.lit(0)), dedup)))
    assert {(r["src"], r["dst"], r["type"]) for r in edges.collect()} == {(1, 2, "uses"), (1, 3, "uses"), (2, 3, "produces"), (3, 3, "follows")}
    raised = {(r["src"], r["dst"]): r["conf"] for r in E.reinforced(candidates).collect() if r["dst"] is not None}
    plain = {(r["src"], r["dst"]): r["conf"] for r in near.collect()}
    assert set(raised) == set(plain) and all(raised[k] >= plain[k] - 1e-9 for k in plain)


def test_backbone_only_without_edges(spark):
    rows = [(1, 1, 0, 0, "INTRO", "a", "Input Fact", 0.9, "neutral"), (1, 2, 1, 0, "INTRO", "b", "Hypothesis", 0.9, "neutral")]
    nodes = spark.createDataFrame(rows, NODES)
    none = spark.createDataFrame([], "doc_id long, src int, dst int")
    assert [(r["src"], r["dst"], r["type"]) for r in G.backbone(spark, nodes, none).collect()] == [(1, 2, "informs")]
    some = spark.createDataFrame([(1, 1, 2)], "doc_id long, src int, dst int")
    assert not G.backbone(spark, nodes, some).count()


def test_router_stops_at_enough(spark):
    s = spark.createDataFrame([(1, i, "or") for i in range(9)] + [(2, 0, "no")], "doc_id long, sent_idx int, text string")
    assert {r["doc_id"]: r["score"] for r in N.routed(s, r"\bor\b").collect()} == {1: 6, 2: 0}


def test_rule_needs_adjacent_tokens(spark):
    t = spark.createDataFrame([(1, 0, "the and the x and"), (1, 1, ""), (1, 2, "a a a")], "doc_id long, sent_idx int, text string")
    got = N.rule_hits(t, [*dims.PACK, ("AA", "Result", ["a", "a"])]).where("rule in ('R_THE', 'AA')").collect()
    assert [(r["sent_idx"], r["hits"]) for r in got] == [(0, 1), (2, 2)]


def test_stream(spark, tmp_path):
    landing = str(tmp_path / "in")
    spark.createDataFrame([(1, "One. Two.")], "doc_id long, text string").write.parquet(landing)
    seen = []
    stream = jobs.run_stream(spark, landing, "doc_id long, text string", str(tmp_path / "c"), lambda df, i: seen.append(R.sentences(df).count()))
    stream.awaitTermination(60)
    assert sum(seen) == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["sentence_stats", "sentence_decision", "proximity_edges", "edge_dedup", "final_graph", "tei_graph", "theme_ranking", "dependency_hits", "layout_columns", "merge_adjacent", "normalize_types"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rel = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({catalog.ORACLES[name]})")
    show = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert show(rel.fetchall()) == show([tuple(r[c] for c in cols) for r in df.collect()])


def test_dependency_hits_stay_within_a_sentence(spark):
    """Against all pairs by brute force; no pairs of tokens are joined or shuffled, only matches."""
    import itertools

    from quillgraph.operators import dependencies

    draw = random.Random(3)
    tokens = [(d, s, i, draw.randrange(i + 1) if draw.random() < 0.9 else i, draw.choice("abcd")) for d in range(6) for s in range(3) for i in range(draw.randrange(1, 14))]
    tokens += [(7, 0, 0, 1, "a"), (7, 0, 1, 2, "b"), (7, 0, 2, 0, "c"), (7, 1, 0, None, "a"), (7, 1, 1, 0, "b"), (None, 0, 0, 0, "a"), (None, 0, 1, 0, "b")]
    pack = [
        {"name": "R", "label": "L", "patterns": [[{"NAME": "x", "TOKEN": "a"}, {"NAME": "y", "ABOVE": "x", "TOKEN": {"IN": ["b", "a"]}}, {"NAME": "z", "ABOVE": "y", "TOKEN": "c", "OP": "?"}]]},
        {"name": "S", "label": "M", "patterns": [[{"NAME": "x", "TOKEN": "b"}, {"NAME": "y", "ABOVE": "x"}, {"NAME": "z", "ABOVE": "x", "TOKEN": "a"}]]},
    ]
    want: dict = {}
    for (d, s), group in itertools.groupby(sorted(tokens, key=lambda t: (t[0] is None, *(t[k] or 0 for k in (0, 1, 2)))), lambda t: t[:2]):
        group = [(i, h, t) for _, _, i, h, t in group] if d is not None else []
        up = {(h, i) for i, h, _ in group if h is not None and h != i}
        for _ in group:
            up |= {(a, c) for a, b in up for e, c in up if b == e}
        word = {i: t for i, _, t in group}
        two = [(x, y) for x, y in up if word[x] == "a" and word[y] in "ab"]
        hits = {"R": two + [(x, y, z) for x, y in two for b, z in up if b == y and word[z] == "c"], "S": [(x, y, z) for x, y in up for b, z in up if b == x and word[x] == "b" and word[z] == "a"]}
        for rule, found in hits.items():
            if found := {tuple(sorted(f)) for f in found if len(set(f)) == len(f)}:
                want[d, s, rule] = len(found), sum(map(len, found))
    table = spark.createDataFrame(tokens, "doc_id long, sent_idx int, i int, head int, token string")
    got = dependencies.dependency_hits(table, pack)
    assert {(r["doc_id"], r["sent_idx"], r["rule"]): (r["matches"], r["tokens"]) for r in got.collect()} == want and len(want) > 8
    query = catalog.QUERIES["dependency_hits"](spark, "/root/testdata/sf0.001")
    assert "Join" not in query._jdf.queryExecution().executedPlan().toString()
