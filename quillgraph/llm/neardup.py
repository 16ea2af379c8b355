"""MinHash near-duplicate removal by improved consistent weighted sampling over TF-IDF shingles.

1. Features: distinct five-word shingles (lower-cased, white-space words) of a whole text, weighted
   tf * ln(1 + N / (1 + df)). df is counted exactly: slices of texts send their shingles to blocks of hashes, a
   block adds up and sends each slice its counts back, and the number of blocks follows the input.
2. Documents with equal word sequences form one text class first; only a representative goes on.
3. Signature: for each of HASHES functions the least ln a over the features, after Ioffe's improved consistent
   weighted sampling by the root of the weight. Two texts agree in one with a probability that lies between their
   weighted and their plain Jaccard similarity, so that texts alike by either meet.
4. BANDS bands of ROWS values each. The texts of a bucket are compared where they meet: each text with those that
   are not yet linked to it in the bucket, have it in no earlier band and agree in AGREE of HASHES signature
   bytes; a pair is linked if the exact weighted Jaccard of the whole texts is SIMILAR or more. Copies make each
   other's shingles common, and their few edits outweigh them the more copies there are: a pair whose shared
   shingles are mostly in more than FEW documents is linked by plain Jaccard too. Pairs stay inside
   the task and links make a spanning forest, so copies of one text cost a comparison each, not one a pair.
   A bucket of more than BIG texts is dealt in chunks: all are compared with its first text, and then those not
   linked to it with all chunks. No bucket is capped.
5. Classes are the connected components of verified links, labelled by their least text.

Random draws are read from two tables by hash, so a draw costs array look-ups only.

Texts are told apart by their word sequence, never by doc_id, so null and repeated ids take part like all others.

Defined results: null text is empty; texts without a word are all one class of equal texts; fewer than five
words make one shingle; repeated rows get one row each with equal class; rows that share a doc_id or have none are
of one class only if their texts are; a class_id is null if no row of the class has an id; an empty table gives no
rows; a null doc_id counts as the largest id; other columns are kept by `deduplicated` and not read by `classes`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bytesutil import LOWER, U64, mixed_bits, prefix_hash, slices, span_hash, trim, words
from quillgraph.llm.rows import BOX, boxed, unboxed
from quillgraph.llm.store import dropped, freed, written

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
#: Bytes of text whose shingles make a block that is counted at once.
BLOCK_BYTES = 8 << 20
DRAW_BITS = 16
#: Copies that do not yet make a larger group.
FEW = 4
#: Signature bytes that must agree before texts are compared: where roots of weights agree by 0.7 the expected number is
#: 45, and 34 is 2.9 deviations below. With 0 every pair of a bucket is compared.
AGREE = 34
BIG = 512
#: Signature features worked on at once: arrays of this size stay in the cache.
BLOCK = 1 << 14


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row, shingle hash, tf; and two 64-bit hashes of each row's word sequence."""
    n = len(offsets) - 1
    low = LOWER[data]
    start, end, row = words(low, offsets)
    w = span_hash(prefix_hash(low), start, end)
    per = np.bincount(row, minlength=n)
    first = np.cumsum(per) - per
    whole = np.zeros((2, n), np.uint64)
    if len(w):
        place = np.arange(len(w)) - first[row]
        for k in (0, 1):
            salted = mixed_bits(w + U64(0xD6E8FEB86659FD93 + k)) * (U64(2) * place.astype(np.uint64) + U64(1))
            some = per > 0
            whole[k, some] = np.add.reduceat(mixed_bits(salted), first[some])
    size = np.minimum(per, SHINGLE)
    shingles = np.maximum(per - SHINGLE + 1, (per > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), shingles)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[owner]
    h = np.zeros(len(owner), np.uint64)
    for i in range(SHINGLE):
        live = size[owner] > i
        if live.all():
            h = (h + w[at + i]) * U64(0xA0761D6478BD642F) if len(h) else h
        else:
            h[live] = (h[live] + w[at[live] + i]) * U64(0xA0761D6478BD642F)
        h ^= h >> U64(29)
    h = mixed_bits(h)
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    return owner[at], h[at], tf, whole[0], whole[1]


def weights(documents: int, df: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """tf-idf."""
    return tf * np.log1p(documents / (1.0 + df)).astype(np.float32)


def _texts_of(data: pa.Scalar, sizes: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of a slice."""
    offsets = np.append(0, np.cumsum(np.frombuffer(zlib.decompress(sizes.as_py()), "<i8")))
    return np.frombuffer(zlib.decompress(data.as_py()), np.uint8), offsets


def _sliced(docs: DataFrame) -> DataFrame:
    """docs (doc_id, t0, t1, text) as one row a slice of texts, their bytes and sizes compressed; written, so that a
    slice holds the same rows in each pass."""
    names = ["doc_id", "t0", "t1"]

    def run(batches):
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b, data, offsets in slices(batch):
                packed = [pa.array([zlib.compress(x, 1)], pa.binary()) for x in (data.tobytes(), np.diff(offsets).astype("<i8").tobytes())]
                cut = np.array([0, b - a], np.int32)
                lists = [pa.ListArray.from_arrays(cut, batch.column(c).slice(a, b - a)) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, *packed], ["slice", *names, "data", "sizes"])
                number += 1

    return written(docs.select(*names, "text").mapInArrow(run, "slice long, doc_id array<long>, t0 array<long>, t1 array<long>, data binary, sizes binary"), "slices")


def document_counts(sliced: DataFrame, size: int) -> DataFrame:
    """(slice, x array<struct<block,df>>): in how many documents each distinct shingle of the slice is, by hash. Hashes
    are dealt in blocks of about BLOCK_BYTES, as many as `size` bytes of text need, and counted where a block meets."""
    bits = max(0, int(np.ceil(np.log2(max(1, size / BLOCK_BYTES)))))

    def hashes(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                h, n = np.unique(features(*_texts_of(batch.column(1)[i], batch.column(2)[i]))[1], return_counts=True)
                if not len(h):
                    continue
                block = (h >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                cuts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(h))
                spans = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[cuts[:-1]]), pa.array(np.repeat(batch.column(0)[i].as_py(), len(spans))),
                        pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([zlib.compress(n[a:b].astype("<u4").tobytes(), 1) for a, b in spans], pa.binary()),
                    ],
                    ["block", "slice", "h", "n"],
                )
                trim()

    def counted(got: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in got["h"]]
        n = np.concatenate([np.frombuffer(zlib.decompress(x.as_py()), "<u4") for x in got["n"]])
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(at, n)[at].astype("<u4")
        ends = np.cumsum([len(x) for x in parts])
        packed = [zlib.compress(df[b - len(x) : b].tobytes(), 1) for x, b in zip(parts, ends)]
        trim()
        return pa.Table.from_arrays([got["slice"], got["block"], pa.array(packed, pa.binary())], ["slice", "block", "df"])

    rows = sliced.select("slice", "data", "sizes").mapInArrow(hashes, "block long, slice long, h binary, n binary")
    found = rows.groupBy("block").applyInArrow(counted, "slice long, block long, df binary")
    return found.groupBy("slice").agg(F.collect_list(F.struct("block", "df")).alias("x"))


class Sampler:
    def __init__(self, seed: int = 20) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        n = 1 << DRAW_BITS
        self.r = draw.gamma(2.0, 1.0, n).astype(np.float32)
        self.beta = draw.random(n).astype(np.float32)
        self.inverse = (1.0 / self.r).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, 1.0, n)).astype(np.float32)
        self.odd = draw.integers(0, 1 << 63, (2, HASHES), dtype=np.uint64) * U64(2) + U64(1)

    def signatures(self, row: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """[n, HASHES] of float32; rows without a feature get infinity."""
        out = np.full((n, HASHES), np.inf, np.float32)
        log_s = np.log(weight).astype(np.float32)
        shift = U64(64 - DRAW_BITS)
        for a in range(0, len(h), BLOCK):
            hb, sb, rb = h[a : a + BLOCK], log_s[a : a + BLOCK], row[a : a + BLOCK]
            first = np.flatnonzero(np.diff(rb, prepend=-1))
            own = rb[first]
            for k in range(HASHES):
                i = ((hb * self.odd[0, k]) >> shift).astype(np.int64)
                j = ((hb * self.odd[1, k]) >> shift).astype(np.int64)
                beta = self.beta[i]
                t = np.floor(sb * self.inverse[i] + beta)
                t -= beta
                t += 1
                t *= self.r[i]
                np.subtract(self.log_c[j], t, out=t)
                out[own, k] = np.minimum(out[own, k], np.minimum.reduceat(t, first))
        return out


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Of two sorted feature lists."""
    total = float(w1.sum()) + float(w2.sum())
    if total == 0:
        return 1.0
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    shared = float(np.minimum(w1[i], w2[j]).sum())
    return shared / (total - shared)


def alike(h1: np.ndarray, w1: np.ndarray, df1: np.ndarray, h2: np.ndarray, w2: np.ndarray, df2: np.ndarray, least: float) -> bool:
    """Whether two sorted feature lists are near copies, by weight or, in larger groups of copies, by number."""
    if weighted_jaccard(h1, w1, h2, w2) >= least:
        return True
    _, i, _ = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    return len(i) >= least * (len(h1) + len(h2) - len(i)) and float(np.median(df1[i])) > FEW


def _signed(sliced: DataFrame, counts: DataFrame, documents: int) -> DataFrame:
    """(doc_id, t0, t1, h0, h1, bands, sig, df): the row's key, the word sequence's hash, the band hashes, a byte of each
    signature value and the packed document counts of the text's shingles."""
    kept: dict[str, Sampler] = {}

    def run(batches):
        if not kept:
            kept["s"] = Sampler()
        for batch in batches:
            for i in range(batch.num_rows):
                ids, t0, t1 = (batch.column(c)[i].values for c in ("doc_id", "t0", "t1"))
                n = len(ids)
                row, h, tf, x, y = features(*_texts_of(batch.column("data")[i], batch.column("sizes")[i]))
                blocks = sorted((p["block"], p["df"]) for p in batch.column("x")[i].as_py() or ())
                found = np.concatenate([np.frombuffer(zlib.decompress(p), "<u4") for _, p in blocks]) if blocks else np.empty(0, np.uint32)
                df = found[np.unique(h, return_inverse=True)[1]]
                cut = np.searchsorted(row, np.arange(n + 1))
                sig = kept["s"].signatures(row, h, np.sqrt(weights(documents, df, tf)), n).view(np.uint32).astype(np.uint64)
                key = np.zeros((n, BANDS), np.uint64)
                for k in range(ROWS):
                    key = mixed_bits(key * U64(0xE7037ED1A0B428DB) + sig[:, k::ROWS])
                small = (mixed_bits(sig) >> U64(56)).astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, t0, t1, pa.array(x.view(np.int64)), pa.array(y.view(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32), key.view(np.int64).ravel()),
                        pa.array([small[k : k + HASHES] for k in range(0, n * HASHES, HASHES)], pa.binary()),
                        pa.array([zlib.compress(df[a:b].tobytes(), 1) for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
                    ],
                    ["doc_id", "t0", "t1", "h0", "h1", "bands", "sig", "df"],
                )
                trim()

    return sliced.join(counts, "slice", "left").mapInArrow(run, "doc_id long, t0 long, t1 long, h0 long, h1 long, bands array<long>, sig binary, df binary")


class Bucket:
    """Texts that are compared in one task; features are made when first needed."""

    def __init__(self, documents: int, texts: list[str], dfs: list[bytes], sigs: list[bytes], bands: np.ndarray) -> None:
        self.documents, self.texts, self.dfs, self.bands = documents, texts, dfs, bands
        self.sigs = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(texts), -1)
        self.made: list = [None] * len(texts)
        self.label = np.arange(len(texts))

    def features(self, i: int):
        if self.made[i] is None:
            data = np.frombuffer((self.texts[i] or "").encode(), np.uint8)
            _, h, tf, _, _ = features(data, np.array([0, len(data)]))
            df = np.frombuffer(zlib.decompress(self.dfs[i]), "<u4")
            self.made[i] = h, weights(self.documents, df, tf), df
        return self.made[i]

    def links(self, i: int, others: np.ndarray, band: int, least: float, first_band: bool):
        """Links of i to texts that have no link to it yet."""
        others = others[self.label[others] != self.label[i]]
        if not len(others):
            return
        others = others[(self.sigs[others] == self.sigs[i]).sum(axis=1) >= AGREE]
        if first_band and band:
            others = others[~(self.bands[others, :band] == self.bands[i, :band]).any(axis=1)]
        for j in others:
            if self.label[i] != self.label[j] and alike(*self.features(i), *self.features(j), least):
                a, b = self.label[i], self.label[j]
                self.label[self.label == max(a, b)] = min(a, b)
                yield int(j)


def _linked(groups: DataFrame, documents: int, least: float, first_band: bool) -> DataFrame:
    """Links (a, b) of rows (band, x array<struct<id,side,bands,sig,df,text>>): side 0 is compared with all, side 1 only
    with side 0."""

    def run(batches):
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                band, x = batch.column(0)[row].as_py(), batch.column(1)[row].values
                ids, side = x.field("id").to_numpy(), x.field("side").to_numpy()
                order = np.lexsort((ids, side))
                x = x.take(pa.array(order))
                ids, side = ids[order], side[order]
                bands = x.field("bands").flatten().to_numpy().reshape(len(ids), -1)
                bucket = Bucket(documents, x.field("text").to_pylist(), x.field("df").to_pylist(), x.field("sig").to_pylist(), bands)
                for i in range(int((side == 0).sum())):
                    others = np.arange(i + 1, len(ids))
                    others = others[ids[others] != ids[i]]
                    for j in bucket.links(i, others, band, least, first_band):
                        out.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
            a, b = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return groups.select("band", "x").mapInArrow(run, "a long, b long")


def _gathered(rows: DataFrame, body: DataFrame, *keys: str) -> DataFrame:
    """rows (band, key, id, side, *keys) with their texts, one row a group."""
    whole = rows.join(body, "id").select("band", "key", *keys, F.struct("id", "side", "bands", "sig", "df", "text").alias("x"))
    return whole.groupBy("band", "key", *keys).agg(F.collect_list("x").alias("x"))


def _big_links(rows: DataFrame, body: DataFrame, documents: int, least: float) -> DataFrame:
    """Links in buckets of more than BIG texts: rows (band, key, id, n)."""
    parts = F.ceil(F.col("n") / BIG)
    firsts = rows.groupBy("band", "key").agg(F.min("id").alias("lo"), F.first("n").alias("n"))
    chunked = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts))
    star = chunked.select("band", "key", "part", "id", F.lit(1).alias("side")).unionByName(
        firsts.select("band", "key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("lo").alias("id"), F.lit(0).alias("side"))
    )
    near = written(_linked(_gathered(star, body, "part"), documents, least, False), "star")
    both = firsts.select("band", "key", "lo")
    left = written(
        chunked.join(both, ["band", "key"]).where(F.col("id") != F.col("lo")).join(near, (F.col("lo") == F.col("a")) & (F.col("id") == F.col("b")), "left_anti").drop("lo"), "far"
    )
    counts = left.groupBy("band", "key").agg(F.ceil(F.count("*") / BIG).alias("rows"))
    grid = (
        left.join(counts, ["band", "key"])
        .withColumn("line", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("rows")))
        .select("band", "key", "line", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "id", F.lit(0).alias("side"))
        .unionByName(
            chunked.join(counts, ["band", "key"]).select(
                "band", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("line"), "part", "id", F.lit(1).alias("side")
            )
        )
    )
    return near.unionByName(_linked(_gathered(grid, body, "line", "part"), documents, least, True))


def components(links: DataFrame) -> DataFrame:
    """(id, label): the least id of each connected component of links(a, b). Labels spread by the links' least
    neighbour and by one look-up of the label's own label a round, so long chains take few rounds."""
    spark = links.sparkSession
    both = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "links")
    labels = written(both.groupBy(F.col("x").alias("id")).agg(F.least(F.col("id"), F.min("y")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("y"), "label"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        low = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        jump = low.select(F.col("id").alias("low"), F.col("low").alias("far"))
        new = written(low.join(jump, "low").select("id", F.col("label").alias("was"), F.least("low", "far").alias("label")), "labels")
        changed = new.where(F.col("label") != F.col("was")).limit(1).count()
        dropped(labels)
        labels = new.select("id", "label")
        if not changed:
            return labels


def _keyed(docs: DataFrame, *names: str) -> tuple[Column, Column]:
    """t0 and t1, two hashes of the text as it stands: with doc_id they name a row, or equal rows."""
    text = F.coalesce("text", F.lit(""))
    return tuple(F.xxhash64(F.lit(k), text).alias(name) for k, name in enumerate(names, 1))


def _classed(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h0, h1), and their texts (h0, h1, copies, label, lead): label names the class, lead is its least row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", *_keyed(docs, "t0", "t1"))
    documents, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    sliced = _sliced(docs)
    signed = written(_signed(sliced, document_counts(sliced, size), documents), "signed")
    dropped(sliced)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")
    texts = signed.groupBy("h0", "h1").agg(F.min(row).alias("row"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("sig").alias("sig"), F.first("df").alias("df"))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "texts")
    freed(spark)  # the counts' shuffles
    rows = texts.where((F.col("h0") != 0) | (F.col("h1") != 0)).select("id", F.posexplode("bands").alias("band", "key"))
    busy = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(busy, ["band", "key"]), "buckets")
    freed(spark)
    near = met.select("id").distinct().join(texts.select("id", "row", "bands", "sig", "df"), "id")
    same = F.col("doc_id").eqNullSafe(F.col("row.doc_id")) & (F.col("t0") == F.col("row.t0")) & (F.col("t1") == F.col("row.t1"))
    body = docs.join(near, same).select("id", "text", "bands", "sig", "df").dropDuplicates(["id"])
    body = written(body, "bodies")
    freed(spark)
    small = met.where(F.col("n") <= BIG).withColumn("side", F.lit(0))
    links = _linked(_gathered(small, body), documents, least, True)
    if met.where(F.col("n") > BIG).limit(1).count():
        links = links.unionByName(_big_links(met.where(F.col("n") > BIG), body, documents, least))
    label = components(written(links, "pairs"))
    dropped(body)
    found = texts.join(label.withColumnRenamed("id", "lid"), F.col("id") == F.col("lid"), "left").select("h0", "h1", "copies", "row", F.coalesce("label", "id").alias("label"))
    leads = found.groupBy("label").agg(F.min("row").alias("lead"))
    return signed.select("doc_id", "h0", "h1"), found.drop("row").join(leads, "label")


def classes(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and copies (documents with the same words), per document."""
    rows, texts = _classed(docs, least)
    return rows.join(texts, ["h0", "h1"]).select("doc_id", F.col("lead.doc_id").alias("class_id"), "copies")


def deduplicated(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """docs without near duplicates: the row with the least id, then text hash, of each class stays, once; of rows
    with that id and text the one whose hash over all columns is least."""
    kept = _classed(docs, least)[1].select(F.col("lead.doc_id").alias("k_id"), F.col("lead.t0").alias("k_t0"), F.col("lead.t1").alias("k_t1")).distinct()
    kept = written(kept, "kept")
    freed(docs.sparkSession)  # before the texts are shuffled again
    own = _keyed(docs, "t0", "t1")
    rows = boxed(docs, doc_id=F.col("doc_id"), t0=own[0], t1=own[1])
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("t0") == F.col("k_t0")) & (F.col("t1") == F.col("k_t1"))
    one = rows.join(kept, same).groupBy("doc_id", "t0", "t1").agg(F.min_by(BOX, F.xxhash64(BOX)).alias(BOX))
    return unboxed(one, docs.columns)
