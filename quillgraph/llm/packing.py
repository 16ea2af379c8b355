"""Vector bin packing of examples into training sequences, with the dot-product heuristic.

An example has a vector (tokens, segments, loss-bearing tokens) and a sequence a limit on each. A sequence is
filled one example after another: of those that fit in every dimension the one with the largest dot product of
its vector and the room that is left, both as shares of the limits, is placed. When none fits, the largest is
cut so that its first part fills the sequence, unless less than MIN_PIECE tokens are free.

Loss-bearing are a document's last tokens, as many as the column `loss` says; without it all but the first, which
nothing predicts. Documents are packed where they are read: each Arrow batch is packed on its own, nothing is
shuffled, and a task holds one batch of ids. So which documents meet depends on the files' splits and the session's
batch limits; reruns with the same agree. Stretches of full sequences are cut off long documents first. The last,
partly filled sequence of a batch is cut by the binary digits of its length, so that each part has a power of two
of tokens and needs no padding.

Defined results: null text is empty and gives only the end id; a null or negative loss is 0, one beyond the document
all of it; repeated rows are packed each on their own; an empty table gives no rows; other columns are not read. A
sequence_id is (partition << 32) + a running number.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bytesutil import LOWER, prefix_hash, ranges, slices, span_hash, trim, words

LENGTH = 2048
SEGMENTS = 256
MIN_PIECE = 16
END_ID = 1
#: Words whose ids a worker remembers, about 40 bytes each.
CACHE_WORDS = 1_000_000
OUT = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: White space, case, marks and scripts that words and whole texts must agree on.
PROBE = "Ab  CD\tÉé\nx.Y\u00a0z \u3000漢字 e\u0301 \r\n12-3\x0bq\x0c'S ﬁ İ ß😀 \u200b."


class Words:
    """Ids of words by the words' hashes, in order of meeting, and where those ids are. A table by the hash's upper bits,
    probed one place after another, tells a word's place without sorting; it is at most half full."""

    def __init__(self) -> None:
        self.hash, self.first, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.table, self.bits = np.full(1 << 16, -1, np.int32), 16

    def spots(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is, or -1."""
        if not len(self.hash):
            return np.full(len(h), -1, np.int32)
        spot = self.spots(h)
        out = self.table[spot]
        rest = np.flatnonzero((self.hash[out] != h) & (out >= 0))
        while len(rest):
            spot[rest] = spot[rest] + 1 & len(self.table) - 1
            got = self.table[spot[rest]]
            out[rest] = got
            rest = rest[(self.hash[got] != h[rest]) & (got >= 0)]
        return out

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """h: different ones that are not here yet."""
        size = np.array([len(x) for x in ids], np.int64)
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))])
        new = np.arange(len(self.hash), len(self.hash) + len(h), dtype=np.int32)
        self.hash, self.first, self.size = (np.concatenate(x) for x in ((self.hash, h), (self.first, first), (self.size, size)))
        if 2 * len(self.hash) > len(self.table):
            self.bits = int(2 * len(self.hash) - 1).bit_length()
            self.table, new = np.full(1 << self.bits, -1, np.int32), np.arange(len(self.hash), dtype=np.int32)
        spot = self.spots(self.hash[new])
        while len(new):
            free = self.table[spot] < 0
            self.table[spot[free]] = new[free]
            left = self.table[spot] != new
            new, spot = new[left], spot[left] + 1 & len(self.table) - 1


class Ids:
    """Token ids of texts. Where white space always ends a token and case does not count (PROBE tells), the ids of a
    text are those of its lower-cased words, one after another; only a text that may hold a special token, and any
    text of another tokenizer, goes to the tokenizer as it is."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Words()
        parts = PROBE.encode().lower().split()
        self.by_word = self.encoded([PROBE])[0] == [i for x in self.encoded([p.decode() for p in parts]) for i in x]

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with END_ID after it, and where each begins."""
        n = len(offsets) - 1
        raw = data.tobytes()
        odd = np.zeros(n, bool)
        if not self.by_word:
            odd[:] = True
        else:
            at = raw.find(b"<|")
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(b"<|", at + 1)
        low = LOWER[data]
        start, end, row = words(low, offsets)
        if odd.any():
            keep = ~odd[row]
            start, end, row = start[keep], end[keep], row[keep]
        h = span_hash(prefix_hash(low), start, end)
        place = self.known.places(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.known.hash) > CACHE_WORDS:
                self.known = Words()
                new = np.arange(len(h))
            own, one = np.unique(h[new], return_index=True)
            one = new[one]
            flat = low.tobytes()
            self.known.add(own, self.encoded([flat[a:b].decode() for a, b in zip(start[one].tolist(), end[one].tolist())]))
            place[new] = self.known.places(h[new])
        # The end of each text is a word of its own; what the tokenizer saw whole stands there too.
        closing = [[END_ID]] * n
        for i, x in zip(np.flatnonzero(odd), self.encoded([raw[offsets[i] : offsets[i + 1]].decode() for i in np.flatnonzero(odd)]) if odd.any() else ()):
            closing[i] = [*x, END_ID]
        own = np.array([len(x) for x in closing], np.int64)
        ids = np.concatenate([self.known.ids, np.fromiter((i for x in closing for i in x), np.uint32, int(own.sum()))])
        per = np.bincount(row, minlength=n)
        ends = np.cumsum(per) + np.arange(n)
        first, size = np.empty(len(row) + n, np.int64), np.empty(len(row) + n, np.int64)
        at = np.arange(len(row)) + row
        first[at], size[at] = self.known.first[place], self.known.size[place]
        first[ends], size[ends] = len(self.known.ids) + np.cumsum(own) - own, own
        total = np.append(0, np.cumsum(size))
        return ids[np.repeat(first, size) + ranges(size)].astype("<u4"), total[np.append(0, ends + 1)]


_ids: dict[str, Ids] = {}


def ids_of(tokenizer: str) -> Ids:
    """The worker's tokenizer, with the words it has met in earlier tasks."""
    if tokenizer not in _ids:
        path = tokenizer
        if not os.path.isabs(path):
            import public_tokenizers

            path = public_tokenizers.path(tokenizer)
        _ids[tokenizer] = Ids(path)
    return _ids[tokenizer]


def vector_pack(sizes: np.ndarray, limits: np.ndarray, min_piece: int = MIN_PIECE, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, first token, tokens). sizes: rows of (tokens, segments, loss tokens), each within limits.

    A cut item's parts are a segment each; its loss tokens are its last ones.
    """
    bins: list[list[tuple[int, int, int]]] = []
    kinds, inverse = np.unique(sizes, axis=0, return_inverse=True)
    stock: list[list[tuple[int, int]]] = [[] for _ in kinds]
    for item, kind in enumerate(inverse.ravel()):
        stock[kind].append((item, 0))
    left = np.array([len(s) for s in stock])
    share = kinds / limits
    columns = np.ascontiguousarray(kinds.T)
    room, own = limits.astype(np.int64).copy(), []
    extra: list[tuple[int, int, np.ndarray]] = []  # the rest of a cut item; at most one at a time
    while left.any() or extra:
        if extra:  # the rest opens the next sequence
            item, first, vector = extra.pop()
            own.append((item, first, int(vector[0])))
            room -= vector
            continue
        fits = left > 0
        for column, most in zip(columns, room):
            fits &= column <= most
        where = np.flatnonzero(fits)
        if len(where):
            k = int(where[np.argmax(share[where] @ (room / limits))])
            item, first = stock[k].pop()
            left[k] -= 1
            own.append((item, first, int(kinds[k, 0])))
            room -= kinds[k]
            if room[0] > 0:
                continue
        elif cut and room[0] >= min_piece and room[1] >= 1:
            k = int(np.flatnonzero(left)[-1])
            item, first = stock[k].pop()
            left[k] -= 1
            tokens, _, loss = map(int, kinds[k])
            part = min(int(room[0]), int(room[2]) + tokens - loss)
            if 0 < part < tokens:
                own.append((item, first, part))
                extra.append((item, first + part, np.array([tokens - part, 1, min(loss, tokens - part)])))
            else:
                stock[k].append((item, first))
                left[k] += 1
        if not own and left.any():  # beyond a limit by itself: a sequence of its own
            k = int(np.flatnonzero(left)[-1])
            item, first = stock[k].pop()
            left[k] -= 1
            own.append((item, first, int(kinds[k, 0])))
        bins.append(own)
        room, own = limits.astype(np.int64).copy(), []
    if own:
        bins.append(own)
    return [b for b in bins if b]


def binary_parts(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences of powers of two of tokens."""
    total = sum(p[2] for p in pieces)
    out, rest = [], list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        need, own = 1 << bit, []
        while need:
            item, first, n = rest.pop(0)
            take = min(n, need)
            own.append((item, first, take))
            need -= take
            if take < n:
                rest.insert(0, (item, first + take, n - take))
        out.append(own)
    return out


def plan(tokens: np.ndarray, loss: np.ndarray, length: int, segments: int, loss_limit: int) -> list[list[tuple[int, int, int]]]:
    """All sequences for documents of these sizes, of which the last `loss` tokens bear loss."""
    full = min(length, loss_limit)
    out = [[(i, j * full, full)] for i, n in enumerate(tokens.tolist()) for j in range(n // full)]
    rest = tokens % full
    items = np.flatnonzero(rest)
    if len(items):
        sizes = np.stack([rest[items], np.ones(len(items), np.int64), np.minimum(loss, rest)[items]], axis=1)
        bins = vector_pack(sizes, np.array([length, segments, loss_limit]))
        base = (tokens - rest)[items].tolist()
        whose = items.tolist()
        bins = [[(whose[i], base[i] + first, n) for i, first, n in b] for b in bins]
        if sum(p[2] for p in bins[-1]) < length:
            bins[-1:] = binary_parts(bins[-1])
        out += bins
    return out


def packed(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", length: int = LENGTH, segments: int = SEGMENTS, loss: str | None = None, loss_limit: int | None = None
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: a path, or the name of one of the public tokenizers, found on each executor. loss: the column with the
    number of a document's last tokens that bear loss; loss_limit: how many of them a sequence holds at most (length).
    """
    most = loss_limit or length

    def run(batches):
        own_ids = ids_of(tokenizer)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            parts = [own_ids.of(data, offsets) for _, _, data, offsets in slices(batch)]
            if not parts:
                continue
            ids = np.concatenate([p[0] for p in parts])
            tokens = np.concatenate([np.diff(p[1]) for p in parts])
            begin = 4 * (np.cumsum(tokens) - tokens)
            raw = memoryview(ids).cast("B")
            bearing = tokens - 1 if loss is None else np.clip(batch.column(2).to_numpy(zero_copy_only=False), 0, tokens)
            rows, start, size, crc, at, place = [], [], [], [], [], []
            for sequence in plan(tokens, bearing, length, segments, most):
                offset = 0
                for item, first, n in sequence:
                    rows.append(item)
                    start.append(first)
                    size.append(n)
                    a = int(begin[item]) + 4 * first
                    crc.append(zlib.crc32(raw[a : a + 4 * n]))
                    at.append(number)
                    place.append(offset)
                    offset += n
                number += 1
            own = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(own), *(pa.array(x, pa.int64()) for x in (start, size, crc)), pa.array(tokens[rows]), pa.array(at, pa.int64()), pa.array(place, pa.int64())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            trim()

    columns = ["doc_id", "text"] if loss is None else ["doc_id", "text", F.coalesce(F.col(loss).cast("long"), F.lit(0)).alias("loss")]
    return docs.select(*columns).mapInArrow(run, OUT.format(kind=docs.schema["doc_id"].dataType.simpleString()))
