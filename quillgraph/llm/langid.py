"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A text is parsed greedily against each
automaton into the longest phrases that occur in that language's sample; the language that needs the fewest
phrases, each weighed by log2 of its sample's length (the cost of pointing at a phrase), wins. Equal costs go
to the language whose phrases are more frequent in its sample, then to the smaller name.

The sample is bounded: at most SAMPLE_ROWS rows and SAMPLE_CHARS characters a language, taken in order of a
hash of doc_id. Everything else covers every text in full: texts are cut into CHUNK characters, which are
parsed side by side as array operations and whose phrases are added up.

Defined results: null text or one without a letter is `und` with score 0; rows with null lang, null text or a
held-out id teach nothing; if nothing was learned every text is `und`; characters that no sample holds are a
phrase each; repeated rows get equal results. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 64
SAMPLE_CHARS = 16_000
CHUNK = 512
SLICE_CHARS = 2_000_000


def remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string")) % n


def labelled_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """lang -> sample text, lower-cased; rows are joined by line feeds and cut at `chars`."""
    # Rows within the bound come first, so that a whole row is taken where there is one.
    order = Window.partitionBy("lang").orderBy(F.length("text") > chars, F.xxhash64("doc_id"), "doc_id", "text")
    taken = (
        docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .select("lang", "doc_id", "text")
        .withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= rows)
        .select("lang", "nth", F.substring("text", 1, chars).alias("text"))
        .collect()  # at most `rows` rows of `chars` characters a language
    )
    out: dict[str, str] = {}
    for lang, _, text in sorted(taken):
        if len(out.get(lang, "")) < chars:
            out[lang] = (out[lang] + "\n" if lang in out else "") + text.lower()
    return {lang: text[:chars] for lang, text in out.items()}


class Automaton:
    """Suffix automaton as one table: table[state * letters + letter] is the next state * letters, or -1."""

    def __init__(self, codes: list[int], letters: int) -> None:
        nexts: list[dict[int, int]] = [{}]
        link, length, count = [-1], [0], [0]
        last = 0
        for c in codes:
            state = len(nexts)
            nexts.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(1)
            p = last
            while p >= 0 and c not in nexts[p]:
                nexts[p][c] = state
                p = link[p]
            if p >= 0:
                q = nexts[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    clone = len(nexts)
                    nexts.append(dict(nexts[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    count.append(0)
                    while p >= 0 and nexts[p].get(c) == q:
                        nexts[p][c] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state
        for state in sorted(range(1, len(nexts)), key=length.__getitem__, reverse=True):
            count[link[state]] += count[state]
        table = np.full((len(nexts), letters), -1, np.int32)
        for state, own in enumerate(nexts):
            for c, to in own.items():
                table[state, c] = to * letters
        self.table, self.root = table.ravel(), np.maximum(table[0], 0)
        self.letters = letters
        self.often = np.log2(1 + np.array(count, np.float64)).astype(np.float32)
        self.often[0] = 0


class Languages:
    def __init__(self, sample: dict[str, str]) -> None:
        self.names = sorted(sample)
        alphabet = sorted(set("".join(sample.values())))
        self.letters = len(alphabet) + 1  # 0: in no sample
        self.code = np.zeros(max(map(ord, alphabet), default=0) + 2, np.int32)
        for i, c in enumerate(alphabet):
            self.code[ord(c)] = i + 1
        self.automata = [Automaton(self.coded(sample[x]).tolist(), self.letters) for x in self.names]
        self.bits = np.array([np.log2(max(2, len(sample[x]))) for x in self.names])

    def coded(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.code[np.minimum(points, len(self.code) - 1)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language: the number of phrases, and the sum of their log frequencies."""
        lowered = [t.lower() for t in texts]
        lengths = np.array([len(t) for t in lowered], np.int64)
        codes = self.coded("".join(lowered))
        parts = -(-lengths // CHUNK)
        row = np.repeat(np.arange(len(texts)), parts)
        within = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.repeat(np.cumsum(lengths) - lengths, parts) + within * CHUNK
        size = np.minimum(CHUNK, np.repeat(lengths, parts) - within * CHUNK)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        live = np.searchsorted(-size, -np.arange(1, CHUNK + 1), "right")
        n, k = len(row), len(self.names)
        state = np.zeros((k, n), np.int32)
        count = np.ones((k, n), np.float64)  # the phrase that the end of the chunk closes
        often = np.zeros((k, n), np.float32)
        for i in range(int(size[0]) if n else 0):
            m = int(live[i])
            c = codes[start[:m] + i]
            for j, a in enumerate(self.automata):
                own = state[j, :m]
                to = a.table[own + c]
                lost = np.flatnonzero(to < 0)
                if len(lost):
                    was = own[lost]
                    count[j, lost] += (was > 0).astype(np.float64) + (c[lost] == 0)
                    often[j, lost] += a.often[was // a.letters]
                    to[lost] = a.root[c[lost]]
                state[j, :m] = to
        for j, a in enumerate(self.automata):
            often[j] += a.often[state[j] // a.letters]
        total = np.stack([np.bincount(row, count[j], len(texts)) for j in range(k)], axis=1)
        frequent = np.stack([np.bincount(row, often[j], len(texts)) for j in range(k)], axis=1)
        return total, frequent

    def decided(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        count, frequent = self.phrases(texts)
        cost = np.round(count * self.bits, 6)
        best = np.lexsort((np.broadcast_to(np.arange(len(self.names)), cost.shape), -frequent, cost), axis=1)[:, 0]
        least = cost[np.arange(len(texts)), best]
        share = 1.0 / np.exp2(np.minimum(0.0, least[:, None] - cost)).sum(axis=1)
        return [self.names[i] for i in best], share

    def accepted(self, texts: list[str]) -> list[str | None]:
        """The language of each text, None for one that is in none of them: most of its letters occur in no sample, so
        that no phrase can hold them."""
        out: list[str | None] = list(self.decided(texts)[0])
        for i, text in enumerate(texts):
            low = text.lower()
            unknown = np.flatnonzero(self.coded(low) == 0)
            if len(unknown) and 2 * sum(low[k].isalpha() for k in unknown) > sum(map(str.isalpha, low)):
                out[i] = None
        return out


def _runs(texts: list[str]):
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE_CHARS:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def with_language(docs: DataFrame, train: DataFrame) -> DataFrame:
    """docs(doc_id, text) with lang_pred and score, learned from train(doc_id, text, lang)."""
    sample = labelled_sample(train)
    shared = docs.sparkSession.sparkContext.broadcast(sample)  # bounded by SAMPLE_CHARS a language
    held: dict[str, Languages] = {}

    def predict(batches):
        if "l" not in held:
            held["l"] = Languages(shared.value)
        languages = held["l"]
        for batch in batches:
            ids, texts, letter = (batch.column(i).to_pylist() if i else batch.column(i) for i in range(3))
            names, scores = ["und"] * len(texts), np.zeros(len(texts))
            wanted = [i for i, ok in enumerate(letter) if ok] if languages.names else []
            own = [texts[i] for i in wanted]
            for a, b in _runs(own):
                got, score = languages.decided(own[a:b])
                scores[wanted[a:b]] = score
                for i, name in zip(wanted[a:b], got):
                    names[i] = name
            yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")).mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double"
    )


def identified(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """The contract of op6: doc_id, held_out, lang_pred, score."""
    out = with_language(docs, docs.where(remainder(F.col("doc_id"), folds) != held))
    return out.select("doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")


def without_rejects(docs: DataFrame, train: DataFrame) -> DataFrame:
    """docs whose text is in some learned language, by its letters and those of the samples; a null lang becomes the
    predicted one. Null texts and those without a letter go; without a learned language all do."""
    shared = docs.sparkSession.sparkContext.broadcast(labelled_sample(train))
    columns = docs.columns
    text_at, lang_at = columns.index("text"), columns.index("lang") if "lang" in columns else None

    def run(batches):
        languages = None
        for batch in batches:
            languages = languages or Languages(shared.value)
            texts = batch.column(text_at).to_pylist()
            names: list[str | None] = []
            for a, b in _runs(texts):
                names += languages.accepted(texts[a:b]) if languages.names else [None] * (b - a)
            out = batch
            if lang_at is not None:
                filled = pc.coalesce(batch.column(lang_at), pa.array(names, pa.string()))
                out = pa.RecordBatch.from_arrays([filled if i == lang_at else c for i, c in enumerate(batch.columns)], names=columns)
            yield out.filter(pa.array([x is not None for x in names], pa.bool_()))

    # The predictor stands in no filter or projection that Spark could move or write out twice.
    return docs.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, docs.schema)
