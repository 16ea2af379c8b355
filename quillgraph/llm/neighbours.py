"""Approximate nearest neighbours by inner product: NN-descent graph, greedy graph search.

1. Equal vectors are one node, with its k + 1 smallest ids (no more can be in a result of k). Nodes are numbered
   when their table is written.
2. Each node starts with the best of the nodes that share a random-hyperplane bucket with it, in TABLES tables;
   buckets are split to about CHUNK nodes.
3. NN-descent: a node's neighbours, forward and up to SAMPLE reverse, are joined with their vectors and compared
   with one another; each keeps its best finds and merges them into its list of DEGREE. Repeated until less than
   SETTLED of the list entries change, ROUNDS times at most.
4. Greedy search: a query starts at its own node and at ENTRIES nodes that all queries share, and expands the best
   BEAM nodes found so far by a join with the graph, until all of them are expanded.
5. The final candidates are scored again in double precision on the original vectors. Queries that found fewer than
   k (a part of the graph that nothing leads out of) are scored against all rows, in blocks.

Graph and search compare vectors rounded to one byte a component; nothing is collected, and a task holds one
bucket chunk or one neighbourhood.

Defined results: vectors that are null, zero or hold null or non-finite components take no part, as candidate or
query; vectors of different lengths are never compared; ties go to the smaller id; fewer candidates than k give
all of them; repeated rows are candidates each, but none with the query's own id; of query rows with one id and
different vectors the least vector asks; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.store import dropped, written

DEGREE = 40
SAMPLE = 20
OFFER = 10
TABLES = 8
CHUNK = 256
ROUNDS = 5
SETTLED = 0.02
BEAM = 256
ENTRIES = 16
#: Rows of the blocks in which queries without enough finds are scored.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def _valid(embedding: Column) -> Column:
    x = F.transform(embedding, lambda e: e.cast("double"))
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda e: e != 0)


def _rounded(batches):
    """(id, embedding) to (id, q): a float32 scale and one signed byte a component."""
    for batch in batches:
        rows = []
        for v in batch.column(1):
            x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            scale = np.abs(x).max() / 127
            rows.append(np.float32(scale).tobytes() + np.rint(x / scale).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "q"])


def _matrix(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def _best(ids: np.ndarray, x: np.ndarray, most: int):
    """For each row of x the `most` others with the largest inner product: (id, their ids, their scores)."""
    n = len(ids)
    if n < 2:
        return
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    k = min(most, n - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    got = np.take_along_axis(s, at, axis=1)
    for i in range(n):
        yield int(ids[i]), ids[at[i]].tobytes(), got[i].astype("<f4").tobytes()


LIST = "u long, ids binary, sims binary"
LIST_SCHEMA = pa.schema([("u", pa.int64()), ("ids", pa.binary()), ("sims", pa.binary())])


def _offers(most: int):
    """From rows (ids array<long>, qs array<binary>): the best finds of each member of the row."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                ids = batch.column(0)[i].values.to_numpy()
                out += _best(ids, _matrix(batch.column(1)[i].values.to_pylist()), most)
                if len(out) > 20_000:
                    yield _lists(out)
                    out = []
            yield _lists(out)

    return run


def _lists(rows: list[tuple]) -> pa.RecordBatch:
    u, ids, sims = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(ids, pa.binary()), pa.array(sims, pa.binary())], schema=LIST_SCHEMA)


def _merged(offers: DataFrame, degree: int) -> DataFrame:
    """One list a node from all its offers: distinct, best first."""

    def run(batches):
        for batch in batches:
            out = []
            for u, parts, scores in zip(*(c.to_pylist() for c in batch.columns)):
                ids, sims = np.frombuffer(b"".join(parts), np.int64), np.frombuffer(b"".join(scores), "<f4")
                ids, at = np.unique(ids, return_index=True)
                order = np.lexsort((ids, -sims[at]))[:degree]
                out.append((u, ids[order].tobytes(), sims[at][order].tobytes()))
            yield _lists(out)

    return offers.groupBy("u").agg(F.collect_list("ids").alias("ids"), F.collect_list("sims").alias("sims")).mapInArrow(run, LIST)


def _edges(graph: DataFrame) -> DataFrame:
    """(u, v, nth) of the packed lists."""

    def run(batches):
        for batch in batches:
            lists = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            n = np.array([len(x) for x in lists], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.concatenate(lists) if lists else np.empty(0, np.int64)), pa.array(np.concatenate([np.arange(k) for k in n]) if lists else np.empty(0, np.int64))],
                ["u", "v", "nth"],
            )

    return graph.select("u", "ids").mapInArrow(run, "u long, v long, nth long")


def _first_lists(nodes: DataFrame, n: int, width: int) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(1, n / CHUNK)))))

    def codes(batches):
        planes = np.random.Generator(np.random.PCG64(7)).normal(size=(TABLES, bits, width)).astype(np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            side = np.einsum("nd,tbd->ntb", _matrix(batch.column(1).to_pylist()), planes) > 0
            code = (side * (1 << np.arange(bits))).sum(axis=2).astype(np.int64)
            k = batch.num_rows
            again = pa.array(np.repeat(np.arange(k), TABLES))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(again), batch.column(1).take(again), pa.array(np.tile(np.arange(TABLES), k)), pa.array(code.ravel())], ["id", "q", "t", "code"]
            )

    rows = nodes.mapInArrow(codes, "id long, q binary, t long, code long")
    sizes = rows.groupBy("t", "code").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    return (
        rows.join(sizes, ["t", "code"])
        .groupBy("t", "code", F.pmod(F.xxhash64("id", "t"), F.col("parts")).alias("part"))
        .agg(F.collect_list("id").alias("ids"), F.collect_list("q").alias("qs"))
        .select("ids", "qs")
        .mapInArrow(_offers(DEGREE), LIST)
    )


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE) -> DataFrame:
    """NN-descent over nodes (id, q), all of one width: (u, ids, sims), lists packed as bytes, best first."""
    n = nodes.count()
    some = nodes.first()
    if some is None or n < 2:
        return nodes.sparkSession.createDataFrame([], LIST)
    graph = written(_merged(_first_lists(nodes, n, len(some["q"]) - 4), degree), "graph")
    for _ in range(ROUNDS):
        edges = _edges(graph).where(F.col("nth") < SAMPLE)
        back = edges.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v"), "u"))).where(F.col("k") <= SAMPLE)
        around = (
            edges.select(F.col("u").alias("centre"), F.col("v").alias("id"))
            .unionByName(back.select(F.col("v").alias("centre"), F.col("u").alias("id")))
            .unionByName(nodes.select(F.col("id").alias("centre"), "id"))
            .distinct()
        )
        local = around.join(nodes, "id").groupBy("centre").agg(F.collect_list("id").alias("ids"), F.collect_list("q").alias("qs")).select("ids", "qs")
        new = written(_merged(local.mapInArrow(_offers(OFFER), LIST).unionByName(graph), degree), "graph")
        same = _edges(new).join(_edges(graph).select("u", "v"), ["u", "v"], "left_semi").count()
        dropped(graph)
        graph = new
        if same >= (1 - SETTLED) * n * min(degree, n - 1):
            break
    return graph


def _scored(pairs: DataFrame) -> DataFrame:
    """(query_id, id, qq, q) to (query_id, id, sim)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sim = np.einsum("nd,nd->n", _matrix(batch.column(2).to_pylist()), _matrix(batch.column(3).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim.astype(np.float64))], ["query_id", "id", "sim"])

    return pairs.select("query_id", "id", "qq", "q").mapInArrow(run, "query_id long, id long, sim double")


def greedy_search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, beam: int = BEAM) -> DataFrame:
    """queries (query_id, id: the node to start at, qq: rounded vector): (query_id, id) of the best nodes found."""
    best = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
    edges = _edges(graph)
    shared = [r["id"] for r in nodes.select("id").orderBy(F.xxhash64(F.lit(11), "id"), "id").limit(ENTRIES).collect()]
    starts = queries.select("query_id", "qq", F.explode(F.array_distinct(F.concat(F.array("id"), F.array(*[F.lit(i) for i in shared])))).alias("id"))
    front = written(_scored(starts.join(nodes, "id")).withColumn("open", F.lit(True)), "beam")
    asked = queries.select("query_id", "qq")
    while front.where("open").limit(1).count():  # a beam only gets better, so no node opens twice
        step = front.where("open").select("query_id", F.col("id").alias("u")).join(edges.select("u", F.col("v").alias("id")), "u").select("query_id", "id").distinct()
        new = step.join(front.select("query_id", "id"), ["query_id", "id"], "left_anti")
        found = _scored(new.join(nodes, "id").join(asked, "query_id")).withColumn("open", F.lit(True))
        kept = front.withColumn("open", F.lit(False)).unionByName(found).withColumn("k", F.row_number().over(best)).where(F.col("k") <= beam).drop("k")
        kept = written(kept, "beam")
        dropped(front)
        front = kept
    return front.select("query_id", "id")


PAIR = "query_id long, vec_id long, score double"


def exact(asked: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the k best rows (vec_id, embedding) for asked (query_id, qe), block by block. A query
    is compared with the rows of its vector's length; all of them, so this is for few queries."""
    blocks, wanted = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-asked.count() // BLOCK_QUERIES))

    def best(key, queries, held):
        import pandas as pd

        out = []
        sizes = held["embedding"].map(len).to_numpy() if len(held) else np.empty(0, np.int64)
        for q, v in zip(queries["query_id"], queries["qe"]):
            own = held[(sizes == len(v)) & (held["vec_id"].to_numpy() != q)] if len(held) else held
            if len(own):
                ids, x = own["vec_id"].to_numpy(np.int64), np.stack(own["embedding"].to_numpy()).astype(np.float64)
                # Added up in the order of the components, as the other scores are.
                score = np.add.accumulate(x * np.asarray(v, np.float64), axis=1)[:, -1]
                keep = np.lexsort((ids, -score))[:k]
                out.append(pd.DataFrame({"query_id": np.full(len(keep), q, np.int64), "vec_id": ids[keep], "score": score[keep]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    left = asked.select("query_id", "qe", F.pmod(F.xxhash64(F.lit(1), "query_id"), F.lit(wanted)).cast("long").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("cb"))
    right = rows.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("long").alias("cb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wanted - 1).cast("long"))).alias("qb"))
    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(best, PAIR)


def nearest(table: DataFrame, k: int, query: Column) -> DataFrame:
    """table (vec_id, embedding); queries are its rows for which `query` holds: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    rows = table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & _valid(F.col("embedding")))
    nth = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k + 1)
    nodes = written(few.where("nth = 1").select("embedding").withColumn("id", F.monotonically_increasing_id()), "vectors")
    members = written(few.select("vec_id", "embedding").join(nodes, "embedding"), "members")
    asked = table.where(query & F.col("vec_id").isNotNull() & _valid(F.col("embedding"))).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("qe"))
    asked = written(asked.join(nodes, F.col("qe") == F.col("embedding")).select("query_id", "qe", "id"), "asked")
    out = []
    for (width,) in nodes.select(F.size("embedding")).distinct().collect():  # lengths of vectors
        own = written(nodes.where(F.size("embedding") == width).select("id", "embedding").mapInArrow(_rounded, "id long, q binary"), "nodes")
        graph = neighbour_graph(own)
        queries = asked.where(F.size("qe") == width).select("query_id", "id").join(own.withColumnRenamed("q", "qq"), "id")
        out.append(greedy_search(queries, graph, own))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    product = F.aggregate(F.zip_with("qe", "embedding", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    scored = (
        found.join(members.select("id", "vec_id", "embedding"), "id")
        .join(asked.select("query_id", "qe"), "query_id")
        .where(F.col("vec_id") != F.col("query_id"))
        .select("query_id", "vec_id", product.alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(pairs: DataFrame) -> DataFrame:
        return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best = written(ranked(scored), "best")
    full = best.where(F.col("rank") == k).select("query_id")
    short = written(asked.select("query_id", "qe").join(full, "query_id", "left_anti"), "short")
    if not short.limit(1).count():
        return best
    return best.join(full, "query_id", "left_semi").unionByName(ranked(exact(short, rows, k)))
