"""Language-model scoring by online logistic context mixing.

A text (A-Z lower-cased) is coded as binary decisions: whether a word of the dictionary follows a usual separator; if
not, which separator or end it is and whether the word is in the dictionary; the first HEAD bits of its Huffman code
there (what is left of a longer code is a choice among rare words, each by its share of their counts), or else its
bytes, each by the bits of a code that the byte before selects. Every decision is predicted by three hashed
contexts, whose zero and one counts come from all training texts:

  separators  which decision; + the word before; + classes of the two words before
  flag        constant; class of the word before; classes of the two before
  code bits   tree node; + class of the word before; + endings of the two words before
  byte bits   tree node + two bytes before; four bytes before; all of the word so far

The first predictor is learned on in the text: a hashed correction of its log odds starts at zero and is moved after
every bit. The log odds are mixed by weights from a set that the confidence of the two higher contexts selects
(gating), then averaged with an adaptive probability map per gate. Correction, weights and map are updated after each
bit, so every decision is predicted from what came before it. A text of more decisions of a kind than SEGMENT is learned
on in segments of that many, each from the starting values; its contexts go on. Starting weights and maps are learned
the same way from all training texts, whose own counts are left out, as means over all segments. score is the log10
probability of all decisions; the two outcomes of a decision add up to 1. bits_per_byte divides the bits by the text's
bytes. A training text is scored with counts that hold its own.

One bit after another is slow in Python, so the passes that code texts run in the JVM: LmCore.java, by lmcore. Coder and
Mixer say the same in numpy, make the tables and starting values, and are what tests hold the class against.

Scale: three passes over the text. Word counts are exact and shuffled by word. Context counts are added up per
partition in slots, then by slot block in groups of FAN parts at most, in as many rounds as the partitions need. The
number of slots follows the training bytes up to MOST_BITS. Broadcast are the slots, two bytes each (34 MB at most),
the dictionary (DICTIONARY words) and the byte codes: all bounded. The counts of words outside the dictionary come by
a join. A task holds one text at a time, a few of its decisions, and for the counts one table of all slots.

Defined results: null text is empty (one token: the end); repeated rows are scored each; without training texts
V and N are 0 and no token is known; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import uuid
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import lmcore
from quillgraph.llm.bytesutil import LOWER, SPACE, U64, prefix_hash, ranges, slices, span_hash, trim, words
from quillgraph.llm.langid import remainder
from quillgraph.llm.store import dropped, written

#: Slots of the three contexts, as powers of two, at most; fewer for less than LEAST_BYTES << bits training bytes.
MOST_BITS = (20, 23, 23)
LEAST_BYTES = 32
DICTIONARY = 1 << 18
#: Rarer words are spelled out.
MIN_COUNT = 4
COMMON = 4096
#: Bits of a word's code that are mixed. All bits would save 0.9 % of the bits a byte and cost a fifth more decisions.
HEAD = 10
FOLDS = 10
#: Decisions of each kind that make a segment.
SEGMENT = (512, 512, 4096, 2048)
#: Bytes and words that numpy works on at once, so that arrays stay in the cache.
SLICE = 1 << 16
EVENTS = 1 << 13
END_WORD = U64(0x6C62272E07BB0142)
START_WORD = U64(0x27D4EB2F165667C5)
KINDS = ("separator", "flag", "code", "byte")
GATES = 9
CELLS = 12
INPUTS = 3
#: Hashed corrections of the first predictor that a segment has.
ONLINE = 256
#: Log odds of counts lie between -STRETCH and STRETCH.
STRETCH = 6.8
RATE, MAP_RATE, OWN_RATE = 0.02, 0.02, 0.08
SURE = 1e-5
#: Slots of a block that is added up in one group, and the parts added up at once.
SLOT_BLOCK = 1 << 16
FAN = 256
#: The bits of a decision's node that are its place in a group of neighbouring slots.
PLACE = np.uint32(15)


def huffman(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits): the path of each symbol from the root; nodes are numbered in order of making."""
    n = len(weights)
    if n <= 1:
        return np.zeros(n + 1, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8)
    heap = [(int(w), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        side[j] = 1
        heapq.heappush(heap, (a + b, node))
    root = 2 * n - 2
    at = np.arange(n)
    owner, nodes, bits, depth = [], [], [], []
    level = 0
    live = at != root
    sym = np.arange(n)
    while live.any():
        sym, at = sym[live], at[live]
        owner.append(sym)
        nodes.append(parent[at] - n)
        bits.append(side[at])
        depth.append(np.full(len(sym), -level))
        at = parent[at]
        live = at != root
        level += 1
    owner, nodes, bits, depth = (np.concatenate(x) for x in (owner, nodes, bits, depth))
    order = np.lexsort((depth, owner))
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=n), out=offsets[1:])
    return offsets, nodes[order].astype(np.int32), bits[order]


def byte_codes(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, bits) of the code of each byte after each byte: symbol before * 256 + byte."""
    made = [huffman(row + 1) for row in pairs.reshape(256, 256)]
    ends = np.cumsum([0] + [m[0][-1] for m in made])
    offsets = np.concatenate([m[0][:-1] + e for m, e in zip(made, ends)] + [ends[-1:]])
    return offsets, np.concatenate([m[1] + k * 256 for k, m in enumerate(made)]), np.concatenate([m[2] for m in made])


class Coder:
    """Turns texts into decisions. words: sorted hashes of the dictionary; counts: theirs; codes: byte_codes()."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, codes: tuple, slot_bits: tuple[int, ...]) -> None:
        self.words = words
        offsets, nodes, bits = huffman(counts)
        size = np.minimum(np.diff(offsets), HEAD)
        path = np.repeat(offsets[:-1], size) + ranges(size)
        self.code = self.grouped(np.append(0, np.cumsum(size)), nodes[path], bits[path])
        #: Bits of the choice that follows the first HEAD of a word's code.
        self.rest = np.zeros(len(words))
        long = np.flatnonzero(np.diff(offsets) > HEAD)
        _, group = np.unique(nodes[offsets[:-1][long] + HEAD], return_inverse=True)
        self.rest[long] = np.log2(np.bincount(group, counts[long])[group] / counts[long])
        offsets, nodes, bits = codes
        self.bytes = self.grouped(offsets, nodes, bits)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        self.rank = rank
        self.shifts = [np.uint32(32 - b) for b in slot_bits]

    @staticmethod
    def spread(nodes: np.ndarray) -> np.ndarray:
        return (nodes.astype(np.uint32) + np.uint32(1)) * np.uint32(0x2C1B3C6D)

    @classmethod
    def grouped(cls, offsets: np.ndarray, nodes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A code whose nodes name their group, the top node of every four levels (28 bits), and their place in it (4 bits)."""
        depth = ranges(np.diff(offsets)) % 4
        top, place = np.arange(len(nodes)) - depth, np.ones(len(nodes), np.uint32)
        for k in range(3):
            below = depth > k
            place[below] = place[below] * 2 + bits[top[below] + k]
        return offsets.astype(np.int32), cls.spread(nodes[top]) & ~PLACE | place, bits.astype(bool)

    @staticmethod
    def context(salt: int, *parts: np.ndarray) -> np.ndarray:
        h = U64(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)
        for p in parts:
            h = (h ^ p) * U64(0xAEF17502108EF2D9)
            h ^= h >> U64(29)
        return (h >> U64(32)).astype(np.uint32)

    def slots_of(self, node: np.ndarray, *contexts: np.ndarray) -> list[np.ndarray]:
        """node: its group, spread over 28 bits, and its place in the group, 4 bits: a group's slots are neighbours in
        memory, in an order that the hash turns, so that all slots fill alike."""
        out = []
        for c, shift in zip(contexts, self.shifts):
            h = c ^ (node & ~PLACE)
            h *= np.uint32(0x297A2D39)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x9E485565)
            h >>= shift
            h ^= node & PLACE
            out.append(h)
        return out

    def look_up(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def events(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Words and ends of all rows, in order, with what their contexts need; data lower-cased."""
        d = len(offsets) - 1
        start, end, row = words(data, offsets)
        per = np.bincount(row, minlength=d)
        prefix = prefix_hash(data)
        at = np.arange(len(start)) + row
        ends = np.cumsum(per) + np.arange(d)
        n = len(start) + d
        ev = {k: np.empty(n, np.int64) for k in ("row", "s", "e")}
        ev["row"][at], ev["row"][ends] = row, np.arange(d)
        ev["s"][at], ev["s"][ends] = start, offsets[1:]
        ev["e"][at], ev["e"][ends] = end, offsets[1:]
        ev["h"] = np.empty(n, np.uint64)
        ev["h"][at], ev["h"][ends] = span_hash(prefix, start, end), END_WORD
        ev["end"] = np.zeros(n, bool)
        ev["end"][ends] = True
        first = np.zeros(n, bool)
        first[ends - per] = True
        second = np.append(False, first[:-1]) | first
        begin = np.where(first, offsets[ev["row"]], np.roll(ev["e"], 1))
        known = self.look_up(ev["h"])
        safe = np.append(data, np.uint8(0))
        tail = np.zeros(n, np.uint64)
        for k in (1, 2):
            some = ev["e"] - ev["s"] >= k
            tail[some] |= data[ev["e"][some] - k].astype(np.uint64) << U64(8 * (k - 1))
        kind = tail + U64(COMMON)
        if len(self.rank):
            common = (known >= 0) & (self.rank[known] < COMMON)
            kind[common] = self.rank[known[common]].astype(np.uint64)

        def before(x: np.ndarray, k: int) -> np.ndarray:
            return np.where(first if k == 1 else second, START_WORD, np.roll(x, k))

        gap, sign = ev["s"] - begin, safe[begin]
        plain = np.where(first, gap == 0, (gap == 1) & (sign == 0x20))
        line = ~first & (gap == 1) & (sign == 0x0A)
        class1, class2 = before(kind, 1), before(kind, 2)
        endings = before(tail, 1) * U64(0x10001) ^ before(tail, 2)
        return ev | {
            "known": known, "begin": begin, "symbol": np.where(ev["end"], np.where(gap == 0, 2, 4), np.where(plain, 0, np.where(line, 1, 3))).astype(np.int8),
            "head": self.context(1, first.astype(np.uint64)), "word": self.context(2, before(ev["h"], 1)), "sep_pair": self.context(3, class1, class2),
            "near": self.context(5, class1), "pair": self.context(6, class1, class2), "endings": self.context(9, endings), "prefix": prefix, "data": safe,
        }

    def decisions(self, ev: dict[str, np.ndarray], a: int, b: int) -> dict[str, tuple]:
        """kind -> (row, bit, slots of the three contexts) of events a to b, in order."""
        symbol, known, end = ev["symbol"][a:b], ev["known"][a:b], ev["end"][a:b]
        row = ev["row"][a:b].astype(np.int32)
        near, pair, endings = ev["near"][a:b], ev["pair"][a:b], ev["endings"][a:b]
        out = {}
        # A known word after a usual separator? Else an unknown one there, the end, a line feed, another separator?
        live, parts = np.arange(b - a, dtype=np.int32), []
        for k, answer in enumerate(((symbol == 0) & (known >= 0), symbol == 0, symbol == 2, symbol == 1, symbol == 3)):
            bit = answer[live]
            parts.append((live, np.full(len(live), k, np.uint32), bit))
            live = live[~bit]
        at, which, bit = (np.concatenate(x) for x in zip(*parts))
        again = np.argsort(at, kind="stable")
        at, which, bit = at[again], which[again], bit[again]
        out["separator"] = (row[at], bit, *self.slots_of(which, ev["head"][a:b][at], ev["word"][a:b][at], ev["sep_pair"][a:b][at]))
        at = np.flatnonzero((symbol == 1) | (symbol == 3))
        out["flag"] = (row[at], known[at] >= 0, *self.slots_of(np.zeros(len(at), np.uint32), self.context(4, np.zeros(len(at), np.uint64)), near[at], pair[at]))
        at = np.flatnonzero(known >= 0)
        offs, nodes, bits = self.code
        lengths = offs[known[at] + 1] - offs[known[at]]
        path = np.repeat(offs[known[at]], lengths) + ranges(lengths).astype(np.int32)
        at = np.repeat(at.astype(np.int32), lengths)
        out["code"] = (row[at], bits[path], *self.slots_of(nodes[path], self.context(7, np.zeros(1, np.uint64)), near[at], endings[at]))
        # Spelled out: odd separators, closed by a zero, and words outside the dictionary, closed by a space.
        odd, new = np.flatnonzero(symbol >= 3), np.flatnonzero(~end & (known < 0))
        at = np.concatenate([odd, new])
        low = np.concatenate([ev["begin"][a:b][odd], ev["s"][a:b][new]])
        high = np.concatenate([ev["s"][a:b][odd], ev["e"][a:b][new]])
        close = np.concatenate([np.zeros(len(odd), np.uint8), np.full(len(new), 0x20, np.uint8)])
        again = np.argsort(at, kind="stable")
        at, low, high, close = at[again], low[again], high[again], close[again]
        size = high - low + 1
        owner, place = np.repeat(np.arange(len(at), dtype=np.int32), size), ranges(size)
        data, prefix = ev["data"], ev["prefix"]
        where, shut = low[owner] + place, close[owner]
        sign = np.where(place == size[owner] - 1, shut, data[where])
        last = np.where(place == 0, shut, data[where - 1])
        so_far = self.context(12, span_hash(prefix, low[owner], where))
        two = self.context(10, span_hash(prefix, np.maximum(low[owner], where - 2), where))
        four = self.context(11, span_hash(prefix, np.maximum(low[owner], where - 4), where))
        offs, nodes, bits = self.bytes
        symbols = last.astype(np.int32) * 256 + sign
        lengths = offs[symbols + 1] - offs[symbols]
        path = np.repeat(offs[symbols], lengths) + ranges(lengths).astype(np.int32)
        of = np.repeat(np.arange(len(owner), dtype=np.int32), lengths)
        node = nodes[path] + ((PLACE + np.uint32(1)) * (shut == 0))[of]
        out["byte"] = (row[at[owner]][of], bits[path], *self.slots_of(node, two[of], four[of], so_far[of]))
        return out


def stretches(ev: dict[str, np.ndarray]):
    """Bounds of runs of EVENTS events."""
    n = len(ev["row"])
    return [(a, min(n, a + EVENTS)) for a in range(0, n, EVENTS)]


def _states() -> tuple[np.ndarray, np.ndarray]:
    """Of counts zeros << 8 | ones: log odds in 256 steps, and how much was seen (0 to 2)."""
    n0, n1 = np.arange(65536) >> 8, np.arange(65536) & 255
    odds = np.log((n1 + 0.3) / (n0 + 0.3))
    seen = np.where(n0 + n1 == 0, 0, np.where(n0 + n1 < 8, 1, 2))
    return np.rint((odds + STRETCH) * (255 / (2 * STRETCH))).astype(np.uint8), seen.astype(np.uint8)


class Mixer:
    """slots: for each context an array of uint16, zeros << 8 | ones, scaled to 255."""

    def __init__(self, slots: list[np.ndarray], start: np.ndarray | None = None, maps: np.ndarray | None = None) -> None:
        self.slots = slots
        self.step, self.seen = _states()
        if start is None:
            start = np.tile(np.array([0.4, 0.3, 0.3], np.float32), (len(KINDS), GATES, 1))
        if maps is None:
            middle = np.arange(CELLS) - CELLS / 2 + 0.5
            maps = np.tile((1 / (1 + np.exp(-middle))).astype(np.float32), (len(KINDS), GATES, 1))
        self.start, self.maps = start, maps

    def packed(self, made: tuple, out_own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, states, gate and bit, place of the correction) of decisions. out_own: a decision's own count is left out."""
        row, bit, *slots = made
        states, gate = np.empty((len(row), 4), np.uint8), np.zeros(len(row), np.uint8)
        for c in range(INPUTS):
            n01 = self.slots[c].take(slots[c].view(np.int32))
            if out_own:
                small = np.where(bit, n01 & 255, n01 >> 8)
                n01 = np.where((small > 0) & (small < 255), n01 - np.where(bit, np.uint16(1), np.uint16(256)), n01)
            states[:, c] = self.step.take(n01)
            if c:
                gate *= 3
                gate += self.seen.take(n01)
        states[:, 3] = gate * 2 + bit
        return row, states.view(np.uint32).ravel(), (slots[0] & np.uint32(ONLINE - 1)).astype(np.uint8)

    def mixed(self, kind: int, parts: list[tuple], rows: int, learned: list | None = None) -> np.ndarray:
        """Bits of each row for decisions of one kind. learned: gets (gates' uses, weights, maps) summed over segments."""
        row, states, online = (np.concatenate(x) for x in zip(*parts))
        if not len(row):
            return np.zeros(rows)
        per = np.bincount(row, minlength=rows)
        lanes = -(-per // SEGMENT[kind])
        nth = ranges(lanes)
        whose = np.repeat(np.arange(rows), lanes)
        size = np.minimum(SEGMENT[kind], per[whose] - nth * SEGMENT[kind])
        order = np.argsort(-size, kind="stable")
        begin = ((np.cumsum(per) - per)[whose] + nth * SEGMENT[kind])[order]
        size, whose, at = size[order], whose[order], begin.copy()
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right").tolist()
        m = len(size)
        weight = np.tile(self.start[kind].T, (1, m))
        maps = np.tile(self.maps[kind].ravel(), m)
        mine = np.zeros(m * ONLINE, np.float32)
        base, first = np.arange(m) * GATES, np.arange(m) * ONLINE
        missed = np.empty(len(row), np.float32)
        edge, low, step = np.float32(5.99), np.float32(-STRETCH), np.float32(2 * STRETCH / 255)
        rate, map_rate, own_rate = np.float32(RATE), np.float32(MAP_RATE), np.float32(OWN_RATE)
        y, done = np.empty((INPUTS, m), np.float32), 0
        for n in live:
            i = at[:n]
            v = states.take(i).view(np.uint8).reshape(n, 4)
            last = v[:, 3]
            b = last & np.uint8(1)
            g = base[:n] + (last >> 1)
            h = first[:n] + online.take(i)
            own = mine.take(h)
            if y.shape[1] != n:
                y = np.empty((INPUTS, n), np.float32)
            np.multiply(v.T[:INPUTS], step, out=y)
            y += low
            y[0] += own
            w = weight.take(g, axis=1)
            dot = np.einsum("cn,cn->n", w, y)
            np.minimum(dot, edge, out=dot)
            np.maximum(dot, -edge, out=dot)
            g *= CELLS
            g += (dot + np.float32(CELLS / 2)).astype(np.int8)
            np.negative(dot, out=dot)
            np.exp(dot, out=dot)
            dot += np.float32(1)
            error = np.subtract(b, np.reciprocal(dot, out=dot), dtype=np.float32)
            q = maps.take(g)
            wrong = np.subtract(b, q, dtype=np.float32)
            np.add(error, wrong, out=missed[done : done + n])
            done += n
            wrong *= map_rate
            wrong += q
            maps[g] = wrong
            np.multiply(error, own_rate, out=dot)
            dot += own
            mine[h] = dot
            error *= rate
            y *= error
            y += w
            g //= CELLS
            for c in range(INPUTS):
                weight[c][g] = y[c]
            i += 1
        if learned is not None:
            lane = np.repeat(np.arange(m), size)
            gates = states[np.repeat(begin, size) + ranges(size)] >> np.uint32(25)
            uses = np.bincount(lane * GATES + gates, minlength=m * GATES).reshape(m, GATES)
            learned.append((uses.sum(axis=0), (weight.reshape(INPUTS, m, GATES) * uses).sum(axis=1).T, (maps.reshape(m, GATES, CELLS) * uses[:, :, None]).sum(axis=0)))
        # The mean of both errors is 1 less the probability of what came; never quite sure, to either side.
        np.abs(missed, out=missed)
        missed *= np.float32(-0.5)
        missed += np.float32(1)
        np.clip(missed, np.float32(SURE), np.float32(1 - SURE), out=missed)
        np.log2(missed, out=missed)
        bits, done = np.zeros(m), 0
        for n in live:
            bits[:n] -= missed[done : done + n]
            done += n
        return np.bincount(whose, bits, rows)


_held: dict[str, tuple] = {}


def _once(kind: str, key: object, make):
    """What the passes of a query share; only the last of a kind stays."""
    if kind not in _held or _held[kind][0] != key:
        _held[kind] = (key, make())
    return _held[kind][1]


def _model(spark: SparkSession, key: str, model, slot_bits: tuple[int, ...]):
    """The coder's tables, broadcast in the JVM."""

    def make():
        coder, counts = Coder(*model.value, slot_bits), model.value[1]
        whole, real = [*map(int, coder.shifts), COMMON, *SEGMENT], [STRETCH, RATE, MAP_RATE, OWN_RATE, SURE]
        return lmcore.shared(
            spark, coder.words, coder.rank.astype(np.int32), *coder.code, *coder.bytes, coder.rest, np.log10(counts + 0.1), np.array(whole, np.int32), np.array(real)
        )

    return _once("model", key, make)


def _counts(spark: SparkSession, key: str, mixer: Mixer):
    """The mixer's slots and what is read from them, broadcast in the JVM."""
    return _once("counts", key, lambda: lmcore.shared(spark, *(np.append(np.zeros(lmcore.PAD, np.uint16), s) for s in mixer.slots), mixer.step, mixer.seen))


def _bytes(train: DataFrame) -> DataFrame:
    return train.select(F.col("text").cast("binary").alias("text"))


def _word_counts(train: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(h, n) of all tokens of the training texts, and the counts of the 65,536 pairs of bytes."""

    def count(batches):
        seen = np.zeros(65536, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch, limit=SLICE):
                low = LOWER[data]
                seen += np.bincount(np.append(np.uint8(0x20), low[:-1]).astype(np.int32) * 256 + low if len(low) else low, minlength=65536)
                start, end, _ = words(low, offsets)
                h, n = np.unique(span_hash(prefix_hash(low), start, end), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(h, END_WORD).view(np.int64)), pa.array(np.append(n, len(offsets) - 1)), pa.nulls(len(h) + 1, pa.int32())], ["h", "n", "pair"]
                )
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(at), np.int64)), pa.array(seen[at]), pa.array(at.astype(np.int32))], ["h", "n", "pair"])

    rows = written(train.select("text").mapInArrow(count, "h long, n long, pair int").groupBy("h", "pair").agg(F.sum("n").alias("n")), "words")
    out = np.zeros(65536, np.int64)
    for pair, n in rows.where("pair is not null").select("pair", "n").collect():  # 65,536 at most
        out[pair] = n
    return rows.where("pair is null").select("h", "n"), out


def _spelling(pairs: np.ndarray) -> np.ndarray:
    """Counts of bytes by the byte before as they are spelled: a space ends any word, a zero a separator."""
    out = pairs.reshape(256, 256).copy()
    gaps = out[:, SPACE].sum(axis=0)
    out[:, 0] += np.where(SPACE, out[:, ~SPACE].sum(axis=1), 0)
    total = out[:, SPACE].sum(axis=1)
    solid = np.flatnonzero(~SPACE)
    out[np.ix_(solid, np.flatnonzero(SPACE))] = 0
    out[solid, 0x20] = total[solid]
    out[0, SPACE] += gaps
    return out


def _dictionary(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most `most`, by the least count that so few words reach."""
    table = counts.where((F.col("h") != F.lit(int(END_WORD.view(np.int64)))) & (F.col("n") >= MIN_COUNT)).groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n"))
    least, total = None, 0
    for n, k in table.limit(most).collect():  # a row for each different count
        total += k
        if total > most:
            break
        least = n
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.where((F.col("n") >= least) & (F.col("h") != F.lit(int(END_WORD.view(np.int64))))).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy(np.int64)[order]


def small(x: np.ndarray) -> bytes:
    """Numbers from 0: how many, a byte for each, 255 at most, and those from there on in full."""
    return np.int32(len(x)).astype("<i4").tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<i8").tobytes()


def whole(raw: bytes) -> np.ndarray:
    """The numbers of small()."""
    n = int(np.frombuffer(raw, "<i4", 1)[0])
    out = np.frombuffer(raw, np.uint8, n, 4).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<i8", -1, 4 + n) if len(raw) > 4 + n else 0
    return out


def _slots(train: DataFrame, key: str, shared, slot_bits: tuple[int, ...]) -> list[np.ndarray]:
    """Zero and one counts of all decisions of the training texts, per context slot, scaled into a byte each."""
    sizes = [2 << b for b in slot_bits]
    bases = [sum(sizes[:c]) for c in range(INPUTS)]
    block_size = min(SLOT_BLOCK, *sizes)
    schema = pa.schema([("block", pa.int32()), ("part", pa.int64()), ("at", pa.binary()), ("n", pa.binary())])

    def packed(block: int, part: int, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"block": [block], "part": [part], "at": [small(np.diff(at, prepend=0))], "n": [small(n)]}, schema)

    def summed(got: pa.Table) -> np.ndarray:
        n = np.zeros(block_size, np.int64)
        for a, b in zip(got["at"], got["n"]):
            n[np.cumsum(whole(a.as_py()))] += whole(b.as_py())
        return n

    def partial(got: pa.Table) -> pa.Table:
        n = summed(got)
        at = np.flatnonzero(n)
        return pa.Table.from_batches([packed(got["block"][0].as_py(), got["part"][0].as_py() // FAN, at, n[at])])

    def final(got: pa.Table) -> pa.Table:
        n = summed(got).reshape(-1, 2)
        most = np.maximum(n.max(axis=1, keepdims=True), 255)
        n = np.where((n > 0) & (most > 255), np.maximum(1, n * 255 // most), n)
        return pa.Table.from_pydict({"block": got["block"][:1], "n": [(n[:, 0] << 8 | n[:, 1]).astype("<u2").tobytes()]}, pa.schema([("block", pa.int32()), ("n", pa.binary())]))

    spark = train.sparkSession
    rows = lmcore.mapped(_bytes(train), "block int, part long, at binary, n binary", lmcore.COUNT, _model(spark, key, shared, slot_bits), None, lmcore.arrays(spark, np.array([block_size], np.int32)))
    parts = train.rdd.getNumPartitions()
    while parts > FAN:
        rows = rows.groupBy("block", F.expr(f"part div {FAN}")).applyInArrow(partial, "block int, part long, at binary, n binary")
        parts = -(-parts // FAN)
    rows = rows.groupBy("block").applyInArrow(final, "block int, n binary")
    out = np.zeros(sum(sizes) // 2, np.uint16)
    for block, n in rows.collect():  # bounded by slot_bits
        out[block * block_size // 2 : (block + 1) * block_size // 2] = np.frombuffer(n, "<u2")
    return np.split(out, [b // 2 for b in bases[1:]])


def _fitted(train: DataFrame, key: str, model, slots, slot_bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Starting weights and maps: means over the segments of all training texts, by uses, from one use each of the plain
    start."""
    width = 1 + INPUTS + CELLS

    spark = train.sparkSession
    plain = Mixer(slots.value)
    values = lmcore.arrays(spark, plain.start, plain.maps)
    sums = lmcore.mapped(_bytes(train), "i long, x double", lmcore.FIT, _model(spark, key, model, slot_bits), _counts(spark, key, plain), values)
    rows = sums.groupBy("i").agg(F.sum("x").alias("x")).collect()  # 4 x 9 x 16
    total = np.zeros(len(KINDS) * GATES * width)
    for i, x in rows:
        total[i] = x
    total = total.reshape(len(KINDS), GATES, width)
    n = total[:, :, :1] + 1
    # Rounded, so that the order of the sums does not show.
    start = np.round((plain.start + total[:, :, 1 : 1 + INPUTS]) / n, 4).astype(np.float32)
    return start, np.round((plain.maps + total[:, :, 1 + INPUTS :]) / n, 4).astype(np.float32)


def slot_bits_for(size: int, most: tuple[int, ...] = MOST_BITS) -> tuple[int, ...]:
    """As many slots as `size` bytes of training text need, one for LEAST_BYTES of them, up to `most`."""
    need = max(12, math.ceil(math.log2(max(1, size / LEAST_BYTES))))
    return tuple(min(b, need) for b in most)


def scored(docs: DataFrame, folds: int = FOLDS, slot_bits: tuple[int, ...] | None = None) -> DataFrame:
    """The contract of op1, and bits_per_byte: learns from the rows whose id's hash is not 0 modulo folds."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (remainder(F.col("doc_id"), folds) == 0).alias("held_out"))
    train = docs.where(~F.coalesce("held_out", F.lit(False)))
    counts, pairs = _word_counts(train)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = counts.where(F.col("h") == F.lit(int(END_WORD.view(np.int64)))).agg(F.sum("n")).first()[0] or 0
    slot_bits = slot_bits or slot_bits_for(int(pairs.sum()))
    model = SimpleNamespace(value=(*_dictionary(counts, DICTIONARY), byte_codes(_spelling(pairs))))
    key = uuid.uuid4().hex
    slots = SimpleNamespace(value=_slots(train, key, model, slot_bits))
    start, maps = _fitted(train, key, model, slots, slot_bits)
    bottom = np.log10(total + 0.1 * (distinct + 1))
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = written(
        lmcore.mapped(
            docs.select("doc_id", F.col("text").cast("binary").alias("text"), "held_out"),
            f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, value double, score double, bits_per_byte double, h array<long>, n array<long>",
            lmcore.SCORE, _model(spark, key, model, slot_bits), _counts(spark, key, Mixer(slots.value)),
            lmcore.arrays(spark, start, maps, np.array([np.log10(ends + 0.1), float(ends > 0)])),
        ),
        "scores",
    )
    for _, held in (_held.pop("model"), _held.pop("counts")):  # written: nothing reads them again
        held.destroy()
    trim()
    rare = table.select("row", F.explode(F.arrays_zip("h", "n")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.n").alias("times"))
    found = rare.join(counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("known_more")
    )
    return table.drop("h", "n").join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("value") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(bottom))).alias("base_score"),
        "score", "bits_per_byte",
    )
