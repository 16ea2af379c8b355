"""Refinement of graphs by a language model: prompt payload, cache, an injected call, repair of its answer, merge.

The call is given by the user and runs on executors, a partition at a time; without one nothing happens. Answers are
cached in a table by the key of their prompt, so a prompt is asked once; an answer that can't be read leaves the document as it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import graph as G
from quillgraph.plans import dims


def repaired(answer: str | None) -> dict | None:
    """The JSON object in an answer: fences and talk around it, trailing commas and missing closers are mended."""
    start = (answer or "").find("{")
    if start < 0:
        return None
    open_, out, quoted, i = [], [], False, start
    while i < len(answer):
        c = answer[i]
        if quoted:
            if c == "\\" and i + 1 < len(answer):
                out.append(c)
                i += 1
                c = answer[i]
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]":
            if c not in open_:
                i += 1
                continue
            _drop_comma(out)
            while open_[-1] != c:
                out.append(open_.pop())
            open_.pop()
        out.append(c)
        i += 1
        if not open_:
            break
    if quoted:
        out.append('"')
    _drop_comma(out)
    try:
        found = json.loads("".join(out + open_[::-1]))
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _drop_comma(out: list[str]) -> None:
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()


def prompts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, prompt, key, tokens) of documents whose graphs fall short: each type's best nodes, with cut texts."""
    short = G.coherence(nodes, edges).where("results < 1 OR hypotheses < 1 OR coherence < 0.6").select("doc_id")
    rows = G.payload(nodes).join(short, "doc_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("type", "k", "node_idx", "text")))
    prompt = F.to_json(F.transform(listed, lambda x: F.struct(x["node_idx"].alias("id"), x["type"].alias("type"), x["text"].alias("text"))))
    out = rows.groupBy("doc_id").agg(prompt.alias("prompt"))
    return out.select("doc_id", "prompt", X.cache_key(F.col("prompt")).alias("key"), X.estimated_tokens(F.col("prompt")).alias("tokens"))


def answered(asked: DataFrame, cache: DataFrame, call: Callable[[str], str], most_tokens: int = 8000) -> DataFrame:
    """New rows of the cache (key, answer, ts): prompts within the budget that it lacks, each asked once.

    A call that raises leaves no row, so it is asked again next time. Write the rows before use: a plan that runs twice asks twice.
    """

    def ask(frames):
        for frame in frames:
            rows = []
            for key, prompt in zip(frame["key"], frame["prompt"]):
                try:
                    rows.append((key, call(prompt)))
                except Exception:  # noqa: BLE001 - whatever the user's call raises, the other documents go on
                    continue
            yield pd.DataFrame(rows, columns=["key", "answer"])

    new = asked.where(F.col("tokens") <= most_tokens).select("key", "prompt").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    return new.mapInPandas(ask, "key string, answer string").withColumn("ts", F.unix_timestamp())


def latest(cache: DataFrame) -> DataFrame:
    """(key, answer): the last write of each key."""
    return cache.groupBy("key").agg(F.max_by("answer", F.struct("ts", "answer")).alias("answer"))


def proposed(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """(doc_id, src, dst, type, conf): the edges of the answers that can be read."""
    key = asked.schema["doc_id"].dataType.simpleString()

    def read(frames):
        for frame in frames:
            rows = []
            for doc_id, answer in zip(frame["doc_id"], frame["answer"]):
                edges = (repaired(answer) or {}).get("edges")
                for e in edges if isinstance(edges, list) else []:
                    try:
                        rows.append((doc_id, int(e["from"]), int(e["to"]), str(e["type"]), min(1.0, max(0.0, float(e.get("conf", 0.6))))))
                    except (KeyError, TypeError, ValueError, AttributeError):
                        continue
            yield pd.DataFrame(rows, columns=["doc_id", "src", "dst", "type", "conf"])

    return asked.select("doc_id", "key").join(latest(cache), "key").select("doc_id", "answer").mapInPandas(read, f"doc_id {key}, src int, dst int, type string, conf double")


def merged(spark: SparkSession, nodes: DataFrame, edges: DataFrame, extra: DataFrame) -> DataFrame:
    """edges (doc_id, src, dst, type, conf, hint) with the proposed ones between live nodes of allowed pairs and types; the higher confidence stays."""
    ends = nodes.select("doc_id", "node_idx", "type")
    pairs = [(a, b, t) for (a, b), (kinds, _) in dims.ALLOWED.items() for t in kinds]
    allowed = F.broadcast(spark.createDataFrame(pairs, "st string, dt string, type string"))
    live = extra.join(ends.toDF("doc_id", "src", "st"), ["doc_id", "src"]).join(ends.toDF("doc_id", "dst", "dt"), ["doc_id", "dst"]).where("src <> dst").join(allowed, ["st", "dt", "type"], "left_semi")
    both = edges.select("doc_id", "src", "dst", "type", "conf", "hint").unionByName(live.select("doc_id", "src", "dst", "type", "conf", F.lit("llm").alias("hint"))).where(F.col("conf") >= dims.GRAPH_MIN)
    best = Window.partitionBy("doc_id", "src", "dst", "type").orderBy(F.desc("conf"), "hint")
    return both.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")

