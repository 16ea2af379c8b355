"""Repeated passages over a corpus: common-prefix intervals of an enhanced suffix array, dealt by anchors.

A passage is any string of `least` bytes that also starts in another document. Sorting all suffixes of a corpus
on one machine does not scale, so the suffix array is dealt into parts that can be sorted on their own:

1. Anchors. In each window of `least` bytes the smallest 24-byte gram by hash (the last of equals) is its
   anchor. It depends on the window's bytes alone, so equal windows have equal anchors at equal offsets, and
   everything about a window can be decided among the occurrences of its anchor.
2. Grams that anchor windows in two documents or more set a bit in a filter of bounded size; windows of other
   anchors cannot repeat. A false positive costs time, never a wrong byte.
3. The rest are contexts: an anchor with the bytes of its run of windows. They are dealt by anchor, hashes first:
   where all contexts of a gram are equal, its least document covers the others at once.
4. Grams with different contexts are dealt again with their bytes. In a part, the contexts' right sides are sorted
   (a suffix array of the positions at anchors) with common-prefix lengths, and a stack scan lists the common-prefix
   intervals: all occurrences that share l bytes to the right, not just neighbours. An interval decides the windows
   that reach further right than its parent's prefix; its members are told apart by their left extension, where
   they differ.
5. A gram that more than HOT batches hold is not gathered in a task: its windows are grouped row by row.
6. Windows that start in a smaller document are covered; covered runs go back to their document.

Rows of the shuffles are packed: one row holds what a batch has for a part.

Defined results: null text is empty; texts shorter than `least` bytes have no passage; a passage repeated only
within one document stays; rows with equal doc_id do not remove each other; a null doc_id counts as the largest;
an empty table gives no rows; other columns are kept by `without_repeats` and not read by `digest`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bytesutil import U64, mixed_bits, powers, prefix_hash, ranges, slices, span_hash, trim
from quillgraph.llm.rows import BOX, boxed, unboxed
from quillgraph.llm.store import freed, written

#: Bytes of a passage; any number from 32 to 250.
LEAST = 50
GRAM = 24
#: Windows worked on at once.
CHUNK = 1 << 17
#: Anchors of the corpus that a group of the first shuffle holds about, and the bits of the filter at most.
GROUP = 1 << 19
FILTER_BITS = 1 << 28
REGION_BITS = 1 << 20
PROBES = 3
#: Anchors that a task gathers before it deals them out.
GATHER = 1 << 17
#: Entries of a gram in the first shuffle (two a batch at most) beyond which it is not gathered.
HOT = 20_000
LAST_ID = (1 << 63) - 1
POSITION = U64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, least: int):
    """Runs of windows with one anchor: (row, first window, last window, anchor, gram hash) arrays per chunk."""
    wide = least - GRAM + 1
    ends = offsets[1:]
    for a in range(0, max(0, len(data) - least + 1), CHUNK):
        b = min(a + CHUNK, len(data) - least + 1)
        part = data[a : b + least - 1]
        p = prefix_hash(part)
        n = len(part) - GRAM + 1
        gram = (p[GRAM:] - p[:n]) * powers("down", n)
        gram ^= gram >> U64(32)
        gram *= U64(0x9FB21C651E98DF25)
        low = (gram & ~POSITION) | (POSITION - np.arange(n, dtype=np.uint64))
        span = 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        m = b - a
        low = np.minimum(low[:m], low[wide - span : wide - span + m])
        at = (POSITION - (low & POSITION)).astype(np.int64)
        first_row = int(np.searchsorted(offsets, a, "right")) - 1
        last_row = int(np.searchsorted(offsets, b - 1, "right")) - 1
        new = np.empty(m, bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        borders = offsets[first_row : last_row + 2]
        inside = borders[(borders > a) & (borders < b)] - a
        new[inside] = True
        stops = ends[first_row : last_row + 1] - least + 1 - a  # the first window that would leave its row
        new[stops[(stops > 0) & (stops < m)]] = True
        first = np.flatnonzero(new)
        row = np.searchsorted(offsets, first + a, "right") - 1
        ok = first + a + least <= ends[row]
        last = np.append(first[1:], m) - 1
        first, last, row = first[ok], last[ok], row[ok]
        anchor = at[first]
        yield row, first + a, last + a, anchor + a, gram[anchor]


def _probe_bits(gram: np.ndarray, region_bits: int) -> list[np.ndarray]:
    h = mixed_bits(gram ^ U64(0x5851F42D4C957F2D))
    return [((h >> U64(20 * k)) & U64(region_bits - 1)).astype(np.int64) for k in range(PROBES)]


def _group_of(gram: np.ndarray, groups: int) -> np.ndarray:
    # Anchors are least hashes, so their values lie low: spread them first.
    return ((mixed_bits(gram) >> U64(32)) * U64(groups) >> U64(32)).astype(np.int64)


def _cut(key: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    return np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else [], len(key)).astype(np.int64)


def _packed(group: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row a group, which must be sorted, with the bytes of each column."""
    cuts = _cut(group)
    return pa.RecordBatch.from_pydict(
        {"g": pa.array(group[cuts[:-1]])} | {k: pa.array([v[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary()) for k, v in columns.items()}
    )


def _unpacked(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table[column].to_pylist()])


def _filled(gram: np.ndarray, region: int) -> bytes:
    bits = np.zeros(region, np.uint8)
    for at in _probe_bits(gram, region):
        bits[at] = 1
    return np.packbits(bits).tobytes()


class Filter:
    """Bitmaps of grams by group, and hot grams, which pass only if asked for."""

    def __init__(self, groups: int, region: int, bitmaps: dict[int, bytes], hot: np.ndarray) -> None:
        self.groups, self.region, self.hot = groups, region, np.sort(hot)
        self.bits = np.zeros((groups, -(-region // 8)), np.uint8)
        for g, own in bitmaps.items():
            self.bits[g] = np.frombuffer(own, np.uint8)

    def passes(self, gram: np.ndarray, hot: bool) -> np.ndarray:
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, gram), len(self.hot) - 1)
            is_hot = self.hot[at] == gram
        else:
            is_hot = np.zeros(len(gram), bool)
        if hot:
            return is_hot
        group, ok = _group_of(gram, self.groups), ~is_hot
        for at in _probe_bits(gram, self.region):
            ok &= (self.bits[group, at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return ok


def _gathered(parts):
    """Dicts of arrays, joined until they hold GATHER grams."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part["gram"])
        if n >= GATHER:
            yield {k: np.concatenate([p[k] for p in held]) for k in part}
            held, n = [], 0
            trim()
    if n:
        yield {k: np.concatenate([p[k] for p in held]) for k in held[0]}


def repeated_filter(docs: DataFrame, least: int, groups: int, region: int) -> tuple[dict[int, bytes], np.ndarray]:
    """Bitmaps of the grams that anchor windows in two documents or more; the hot ones among them."""

    def met(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, _, data, offsets in slices(batch):
                for row, _, _, _, gram in anchors(data, offsets, least):
                    yield {"gram": gram, "doc": ids[first + row]}

    def found(batches):
        for x in _gathered(met(batches)):
            gram, doc = x["gram"], x["doc"]
            order = np.lexsort((doc, gram))
            gram, doc = gram[order], doc[order]
            cuts = _cut(gram)
            low, high = cuts[:-1], cuts[1:] - 1
            high = high[doc[high] != doc[low]]  # the least document and, if another, the greatest
            keep = np.sort(np.concatenate([low, high]))
            group = _group_of(gram[keep], groups)
            order = np.argsort(group, kind="stable")
            yield _packed(group[order], gram=gram[keep][order], doc=doc[keep][order])

    def region_of(table: pa.Table) -> pa.Table:
        gram, doc = _unpacked(table, "gram", np.uint64), _unpacked(table, "doc", np.int64)
        order = np.argsort(gram, kind="stable")
        gram, doc = gram[order], doc[order]
        cuts = _cut(gram)
        first = cuts[:-1]
        many = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first)
        hot = many & (np.diff(cuts) > HOT)
        return pa.table({"g": table["g"][:1], "bits": pa.array([_filled(gram[first[many]], region)], pa.binary()), "hot": pa.array([gram[first[hot]].tobytes()], pa.binary())})

    rows = docs.select("id", "text").mapInArrow(found, "g long, gram binary, doc binary").groupBy("g").applyInArrow(region_of, "g long, bits binary, hot binary").collect()
    hot = np.concatenate([np.frombuffer(r["hot"], np.uint64) for r in rows]) if rows else np.empty(0, np.uint64)
    return {r["g"]: bytes(r["bits"]) for r in rows}, hot  # FILTER_BITS, and one gram of HOT entries, at most


def _runs(batch: pa.RecordBatch, least: int, shared: Filter, hot: bool, whole: bool):
    """Contexts of a batch (id, text, tkey) whose gram passes: arrays by name; with their bytes if whole."""
    ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
    for start, _, data, offsets in slices(batch):
        prefix = prefix_hash(data)
        for row, first, last, anchor, gram in anchors(data, offsets, least):
            ok = shared.passes(gram, hot)
            if not ok.any():
                continue
            row, first, last, anchor, gram = (x[ok] for x in (row, first, last, anchor, gram))
            out = {
                "gram": gram, "id": ids[start + row], "tkey": keys[start + row], "first": first - offsets[row],
                "before": (anchor - first).astype(np.uint8), "n": (last - first + 1).astype(np.uint8),
                "ctx": mixed_bits(span_hash(prefix, first, last + least) + (anchor - first).astype(np.uint64)),
            }
            if whole:
                size = last - first + least
                out["body"] = data[np.repeat(first, size) + ranges(size)]
            yield out


COLUMNS = {"gram": np.uint64, "id": np.int64, "tkey": np.int64, "first": np.int64, "before": np.uint8, "n": np.uint8, "ctx": np.uint64}
SPANS = "id long, tkey long, span long"


def _spans(id_: np.ndarray, tkey: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Table:
    """A covered run as one number: start << 16 | bytes."""
    return pa.table({"id": id_, "tkey": tkey, "span": start << 16 | size})


def equal_contexts(docs: DataFrame, least: int, shared, region: int) -> DataFrame:
    """(id, tkey, span) covered where all contexts of a gram are equal, and (g, bits) of the other grams."""

    def packed(batches):
        for x in _gathered(part for batch in batches for part in _runs(batch, least, shared.value, False, False)):
            group = _group_of(x["gram"], shared.value.groups)
            order = np.argsort(group, kind="stable")
            yield _packed(group[order], **{k: v[order] for k, v in x.items() if k != "before"})

    def decided(table: pa.Table) -> pa.Table:
        trim()
        x = {k: _unpacked(table, k, kind) for k, kind in COLUMNS.items() if k != "before"}
        order = np.lexsort((x["ctx"], x["gram"]))
        x = {k: v[order] for k, v in x.items()}
        grams = _cut(x["gram"])
        same = np.append(True, (x["gram"][1:] != x["gram"][:-1]) | (x["ctx"][1:] != x["ctx"][:-1]))
        kinds = np.add.reduceat(same.astype(np.int64), grams[:-1])
        low = np.repeat(np.minimum.reduceat(x["id"], grams[:-1]), np.diff(grams))
        at = np.flatnonzero((x["id"] > low) & np.repeat(kinds == 1, np.diff(grams)))
        spans = _spans(x["id"][at], x["tkey"][at], x["first"][at], x["n"][at].astype(np.int64) - 1 + least)
        bits = _filled(x["gram"][grams[:-1]][kinds > 1], region)
        tail = pa.table({"id": pa.nulls(1, pa.int64()), "tkey": pa.nulls(1, pa.int64()), "span": pa.nulls(1, pa.int64()), "g": table["g"][:1].combine_chunks(), "bits": pa.array([bits], pa.binary())})
        spans = spans.append_column("g", pa.nulls(len(at), pa.int64())).append_column("bits", pa.nulls(len(at), pa.binary()))
        return pa.concat_tables([spans, tail])

    schema = "g long, " + ", ".join(f"{k} binary" for k in COLUMNS if k != "before")
    return docs.mapInArrow(packed, schema).groupBy("g").applyInArrow(decided, SPANS + ", g long, bits binary")


def unequal_contexts(docs: DataFrame, least: int, shared) -> DataFrame:
    """(id, tkey, span) covered among grams with different contexts."""

    def packed(batches):
        for all_ in _gathered(part for batch in batches for part in _runs(batch, least, shared.value, False, True)):
            body = all_.pop("body")
            size = all_["n"].astype(np.int64) - 1 + least
            starts = np.cumsum(size) - size
            group = _group_of(all_["gram"], shared.value.groups)
            order = np.argsort(group, kind="stable")
            out = _packed(group[order], **{k: v[order] for k, v in all_.items()})
            cuts = _cut(group[order])
            bodies = [body[np.repeat(starts[o], size[o]) + ranges(size[o])].tobytes() for o in (order[i:j] for i, j in zip(cuts[:-1], cuts[1:]))]
            yield out.append_column("body", pa.array(bodies, pa.binary()))

    def decided(table: pa.Table) -> pa.Table:
        trim()
        x = {k: _unpacked(table, k, kind) for k, kind in COLUMNS.items()}
        body = _unpacked(table, "body", np.uint8).tobytes()
        size = x["n"].astype(np.int64) - 1 + least
        starts = np.cumsum(size) - size
        order = np.lexsort((x["ctx"], x["gram"]))
        new = np.append(True, (np.diff(x["gram"][order]) != 0) | (np.diff(x["ctx"][order]) != 0))
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        low = np.minimum.reduceat(x["id"][order], np.flatnonzero(new))
        ctx = [body[starts[i] : starts[i] + size[i]] for i in first]
        got = least_documents(ctx, x["before"][first].astype(np.int64), x["n"][first].astype(np.int64), low, least)
        n = x["n"].astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        nth = ranges(n)
        hit = np.flatnonzero(got[which[owner], x["before"][owner].astype(np.int64) - nth] < x["id"][owner])
        own, nth = owner[hit], nth[hit]
        if not len(hit):  # the contexts differ, and no window of theirs is in a smaller document
            return _spans(*(np.empty(0, np.int64) for _ in range(4)))
        i = np.flatnonzero(np.append(True, (np.diff(nth) != 1) | (np.diff(own) != 0)))
        j = np.append(i[1:], len(hit)) - 1
        return _spans(x["id"][own[i]], x["tkey"][own[i]], x["first"][own[i]] + nth[i], nth[j] - nth[i] + least)

    schema = "g long, " + ", ".join(f"{k} binary" for k in [*COLUMNS, "body"])
    return docs.mapInArrow(packed, schema).groupBy("g").applyInArrow(decided, SPANS)


def hot_contexts(docs: DataFrame, least: int, shared) -> DataFrame:
    """(id, tkey, span) covered among hot grams, in rows: equal contexts and equal windows are reduced before and
    after the shuffle, and the join back is one that Spark can split."""

    def rows(batches):
        for batch in batches:
            for x in _runs(batch, least, shared.value, True, True):
                size = x["n"].astype(np.int64) - 1 + least
                ends = np.append(0, np.cumsum(size)).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(x["body"])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["id"]), pa.array(x["tkey"]), pa.array(x["first"]), pa.array(x["n"].astype(np.int32)), pa.array(x["gram"].view(np.int64)), pa.array(x["ctx"].view(np.int64)), body],
                    ["id", "tkey", "first", "n", "gram", "ctx", "body"],
                )

    found = written(docs.mapInArrow(rows, "id long, tkey long, first long, n int, gram long, ctx long, body binary"), "hot")
    unique = found.groupBy("gram", "ctx", "n", "body").agg(F.min("id").alias("doc"))
    windows = unique.select("gram", "ctx", "doc", "body", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("w")).select(
        "gram", "ctx", "doc", "w", F.expr(f"substring(body, w + 1, {least})").alias("win")
    )
    lows = windows.groupBy("win").agg(F.min("doc").alias("low"))
    known = windows.select("gram", "ctx", "w", "win").join(lows, "win").select("gram", "ctx", "w", "low")
    return (
        found.select("id", "tkey", "first", "gram", "ctx")
        .join(known, ["gram", "ctx"])
        .where(F.col("low") < F.col("id"))
        .select("id", "tkey", (F.shiftleft(F.col("first") + F.col("w"), 16) + least).alias("span"))
    )


def lcp_intervals(lcp: list[int]):
    """Stack scan of common-prefix lengths (lcp[i]: of entries i-1 and i): (length, parent's length, first, last)
    of every interval of two entries or more that share a longer prefix than their surroundings."""
    stack = [(0, 0)]
    n = len(lcp)
    for i in range(1, n + 1):
        now = lcp[i] if i < n else 0
        left = i - 1
        while stack[-1][0] > now:
            length, left = stack.pop()
            yield length, max(stack[-1][0], now), left, i - 1
        if stack[-1][0] < now:
            stack.append((now, left))


def least_documents(ctx: list[bytes], before: np.ndarray, n: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """[contexts, offsets]: the least document with the same window, for windows that start `offset` before the anchor."""
    most = least - GRAM
    size = np.array([len(c) for c in ctx], np.int64)
    flat = np.frombuffer(b"".join(ctx), np.uint8)
    starts = np.cumsum(size) - size
    right = size - before
    count = len(ctx)
    # Bytes of UTF-8 are below 0xFF, so 1 can be added to tell them from padding.
    sides = np.zeros((count, most + -(-least // 8) * 8), np.uint8)
    col = ranges(size) - np.repeat(before - most, size)
    sides[np.repeat(np.arange(count), size), col] = flat + 1
    keys = np.ascontiguousarray(sides[:, most:]).view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    tail = sides[order, most : most + least]
    same = tail[1:] == tail[:-1]
    lcp = np.zeros(count, np.int64)
    lcp[1:] = np.where(same.all(axis=1), least, same.argmin(axis=1))
    lcp[1:] = np.minimum(lcp[1:], np.minimum(right[order][1:], right[order][:-1]))
    lcp[lcp < GRAM] = 0
    left = sides[order, :most]
    docs, reach = doc[order], before[order]
    out = np.repeat(docs[:, None], most + 1, axis=1)
    for length, parent, a, b in lcp_intervals(lcp.tolist()):
        low, high = least - length, min(most, least - parent - 1)
        if low > most:
            continue
        sub = left[a : b + 1]
        differ = np.flatnonzero((sub != sub[0]).any(axis=0))
        common = min(most - 1 - int(differ[-1]) if len(differ) else most, int(reach[a : b + 1].max()))
        own = docs[a : b + 1]
        # No left diversity up to `common`: the whole interval is one repeat.
        if common >= low:
            top = min(common, high)
            out[a : b + 1, low : top + 1] = own.min()
        if b - a == 1:
            continue
        for o in range(max(low, common + 1), high + 1):
            able = np.flatnonzero(reach[a : b + 1] >= o)
            if len(able) < 2:
                break
            key = np.ascontiguousarray(sub[able, most - o :]).view(np.dtype((np.void, o))).ravel()
            _, which = np.unique(key, return_inverse=True)
            lows = np.full(which.max() + 1, LAST_ID)
            np.minimum.at(lows, which, own[able])
            out[a + able, o] = lows[which]
    back = np.empty_like(out)
    back[order] = out
    return back


def repeated_spans(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, tkey, span): runs of bytes covered by windows that start in a smaller document; runs may overlap.

    docs: (id, text, tkey).
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-(total // 13) // GROUP))
    region = REGION_BITS
    while region * groups > FILTER_BITS and region > 64:
        region //= 2
    share = spark.sparkContext.broadcast
    bitmaps, hot = repeated_filter(docs, least, groups, region)
    freed(spark)
    equal = written(equal_contexts(docs, least, share(Filter(groups, region, bitmaps, hot)), region), "equal")
    freed(spark)
    others = {r["g"]: bytes(r["bits"]) for r in equal.where("bits is not null").select("g", "bits").collect()}  # FILTER_BITS at most
    spans = equal.where("bits is null").select("id", "tkey", "span")
    spans = spans.unionByName(written(unequal_contexts(docs, least, share(Filter(groups, region, others, hot))), "unequal"))
    if len(hot):
        spans = spans.unionByName(written(hot_contexts(docs, least, share(Filter(groups, region, {}, hot))), "hot"))
    freed(spark)
    return spans


def _with_spans(docs: DataFrame, least: int) -> DataFrame:
    """boxed docs with spans (null where nothing is covered)."""
    rows = boxed(docs, id=F.coalesce(F.col("doc_id"), F.lit(LAST_ID)), tkey=F.xxhash64("text"))
    text = F.coalesce(F.col(BOX).getField("text"), F.lit(""))
    spans = repeated_spans(rows.select("id", text.alias("text"), "tkey"), least)
    own = spans.groupBy(F.col("id").alias("s_id"), F.col("tkey").alias("s_key")).agg(F.collect_list("span").alias("spans"))
    return rows.join(own, (F.col("id") == F.col("s_id")) & (F.col("tkey") == F.col("s_key")), "left").select(BOX, "spans")


def merged(spans) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    code = np.sort(np.asarray(spans, np.int64))
    start = code >> 16
    end = np.maximum.accumulate(start + (code & 0xFFFF))
    cuts = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return list(zip(start[cuts].tolist(), end[np.append(cuts[1:], len(code)) - 1].tolist()))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    return b"".join(out) + text[at:]


def digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The contract of op9: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                body = (text or "").encode()
                spans = merged(spans) if spans else []
                rows.append((len(body), sum(e - s for s, e in spans), len(spans), hashlib.sha256(_kept(body, spans)).hexdigest()))
            a, b, c, d = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (a, b, c)), pa.array(d, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = _with_spans(docs.select("doc_id", "text"), least)
    found = found.select(F.col(BOX).getField("doc_id").alias("doc_id"), F.col(BOX).getField("text").alias("text"), "spans")
    return found.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the covered bytes cut out of text; a character that loses a byte goes as a whole. n_chars follows.

    Null texts stay null."""

    @F.pandas_udf("string")
    def kept(text, spans):
        import pandas as pd

        return pd.Series([t if t is None or x is None or not len(x) else _kept(t.encode(), merged(x)).decode("utf-8", "ignore") for t, x in zip(text, spans)])

    text = F.col(BOX).getField("text")
    # Only texts with spans visit Python.
    rows = _with_spans(docs, least).withColumn("cut", kept(F.when(F.col("spans").isNotNull(), text), F.col("spans")))
    left = F.coalesce("cut", text)
    changed = {"text": left}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(left).cast(docs.schema["n_chars"].dataType)
    return unboxed(rows, docs.columns, **changed)
