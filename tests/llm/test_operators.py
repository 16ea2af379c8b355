"""Each operator against brute force on small tables with nulls, empty and long texts, ties, copies, extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import langid, lmscore, mixing, neardup, neighbours, packing, quotes, repeats, topk, urlfilter

R = random.Random(4)
WORDS = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "straße", "Mu", "nu", "xi", "omicron"]


def prose(n):
    return " ".join(R.choice(WORDS) + str(R.randrange(30)) for _ in range(n))


def _corpus():
    base = prose(60)
    rows = [(0, None), (1, ""), (2, " \n "), (3, base), (4, base), (5, base + " end"), (6, prose(3000)), (7, "x"), (8, prose(40) + " " + base[:120] + " " + prose(40)), (None, base)]
    rows += [(i, prose(R.randrange(1, 80))) for i in range(9, 40)]
    return [(i, t, ["en", "de", None][(i or 0) % 3], ["a", "b", None, "é"][(i or 0) % 4], len(t or ""), "extra") for i, t in rows]


ROWS = _corpus()


def corpus():
    return ROWS


DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing(spark, docs, empty):
    got = mixing.taken_words(docs).collect()
    sizes, size = {}, {}
    for i, t, _, s, _, _ in corpus():
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        sizes[s] = sizes.get(s, 0) + size[i]
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:  # the excess over the cap is shared again
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] <= level * weight[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    source = {i: s for i, _, _, s, _, _ in corpus()}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert math.isclose(r["target"], target[source[r["doc_id"]]], rel_tol=1e-9) and r["taken"] <= 2 * r["size"]
    assert sorted(got, key=str) == sorted(mixing.taken_words(docs.repartition(3)).collect(), key=str)
    assert mixing.resampled(docs).columns == docs.columns
    assert mixing.taken_words(empty).count() == 0


def test_mixing_deals_rows_once(spark, docs):
    """Whole rows are shuffled once."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (mixing.resampled(docs), mixing.taken_words(docs)):
            plan = made._jdf.queryExecution().executedPlan().toString()
            kinds = re.findall(r"Exchange hashpartitioning\((\w+)", plan)
            assert kinds.count("none") == 2 and "class" not in kinds  # rows and first ranks, by the same keys
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_packing_is_an_exact_partition(docs, empty):
    rows = packing.packed(docs).collect()
    from tokenizers import Tokenizer
    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, t, *_ in corpus():
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        at = 0
        for r in own:
            assert r["start"] == at
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at], "<u4").tobytes())
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == np.cumsum([0] + [r["length"] for r in s[:-1]]).tolist() and sum(r["length"] for r in s) <= 2048
    assert packing.packed(empty).count() == 0


def test_vector_pack_keeps_every_limit():
    sizes = np.array([[R.randrange(1, 100), 1, 0] for _ in range(200)])
    sizes[:, 2] = [R.randrange(0, n + 1) for n in sizes[:, 0]]
    loss = {i: r[2] for i, r in enumerate(sizes)}
    bins = packing.vector_pack(sizes, np.array([128, 5, 60]), cut=False)
    assert sorted(p[0] for b in bins for p in b) == list(range(200))
    for b in bins:
        big = any(loss[p[0]] > 60 for p in b)
        assert sum(p[2] for p in b) <= 128 and len(b) <= 5 and (big or sum(loss[p[0]] for p in b) <= 60)


def test_vector_pack_cuts_within_every_limit():
    sizes = np.array([[R.randrange(1, 128), 1, 0] for _ in range(300)])
    sizes[:, 2] = [R.randrange(0, min(60, n) + 1) for n in sizes[:, 0]]
    bins = packing.vector_pack(sizes, np.array([128, 6, 60]), min_piece=4)
    met = collections.Counter()
    for b in bins:
        bearing = 0
        for item, first, n in b:
            met[item] += n
            silent = sizes[item][0] - sizes[item][2]
            bearing += max(0, first + n - max(first, silent))
        assert sum(p[2] for p in b) <= 128 and len(b) <= 6 and bearing <= 60
    assert [met[i] for i in range(300)] == sizes[:, 0].tolist()


def test_packing_by_loss_column(spark):
    rows = [(i, prose(R.randrange(0, 900)), R.choice([None, -3, 0, 5, 200, 10**6])) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, bearing long")
    got = packing.packed(table, length=256, segments=4, loss="bearing", loss_limit=100).collect()
    bearing, seqs = {r[0]: max(0, r[2] or 0) for r in rows}, collections.defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append(r)
    for s in seqs.values():
        live = sum(max(0, r["start"] + r["length"] - max(r["start"], r["doc_tokens"] - min(bearing[r["doc_id"]], r["doc_tokens"]))) for r in s)
        assert sum(r["length"] for r in s) <= 256 and len(s) <= 4 and live <= 100


def test_words_stay_in_place():
    """Words keep their places when others come, also with equal upper bits and when the table grows; nothing is sorted."""
    g = np.random.default_rng(2)
    known, met = packing.Words(), np.empty(0, np.uint64)
    for n in (1, 500, 60000):
        h = np.setdiff1d(np.append(g.integers(0, 2**63, n, np.uint64), (np.uint64(2**64 - 1) - np.arange(n, n + 40, dtype=np.uint64))), met)
        g.shuffle(h)
        assert (known.places(h) < 0).all()
        known.add(h, [[int(x % np.uint64(1000))] * (i % 3) for i, x in enumerate(h)])
        met = np.append(met, h)
        assert np.array_equal(known.places(met), np.arange(len(met)))
    at = known.places(met[::-1])
    assert all(known.ids[a : a + n].tolist() == [int(x % np.uint64(1000))] * int(n) for a, n, x in zip(known.first[at][:500], known.size[at][:500], met[::-1][:500]))


def test_ids_of_odd_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing.ids_of("word_bpe_49k.json")
    texts = ["", " ", "A b  C", "<|x|> a <|endoftext|>", "İSTANBUL ﬁ ß", "a\u00a0b\u2003c\u3000d", "x\x00y \x1c z", packing.PROBE, "é e\u0301 漢字かな", prose(50)] * 3
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    for _ in range(2):
        ids, cut = own.of(data, offsets)
        for i, t in enumerate(texts):
            assert ids[cut[i] : cut[i + 1]].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]
    assert own.by_word


def test_language(spark, empty):
    de, fr = "der die das und ist nicht ein schön über", "le la les est pas une été où ça"
    rows = [(i, " ".join(R.sample((de if i % 2 else fr).split(), 6)), "de" if i % 2 else "fr") for i in range(60)] + [(90, None, "de"), (91, "12 !", "fr"), (92, "", None), (93, de * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identified(docs).collect()}
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "fr") for i in range(60)) and got[93]["lang_pred"] == "de"
    assert [got[i]["lang_pred"] for i in (90, 91, 92)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.values())
    assert langid.identified(empty).count() == 0


def test_automaton_parses_longest_phrases():
    sample, text = "abracadabra", "cadabrax abra"
    langs = langid.Languages({"x": sample})
    want, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) + 0 and text[at : at + n + 1] in sample:
            n += 1
        want, at = want + 1, at + n
    assert langs.phrases([text])[0][0, 0] in (want, want + 1)  # the end may close an empty phrase


def test_near_duplicates(docs, empty):
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got[3] == got[4] == got[5] == got[None] == 3 and got[0] == got[1] == got[2] == 0
    assert all(got[i] == i for i in [6, 7, 8, *range(9, 40)])
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(got.values()))
    assert neardup.classes(empty).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, b, c, d = (prose(40) for _ in range(4))
    rows = [(None, a), (None, b), (None, b + " end"), (5, c), (5, d), (5, d), (2, d + " end"), (9, a + " end")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["text"]) for r in neardup.deduplicated(table).collect()}
    assert (2, d + " end") in got and (5, c) in got and (9, a + " end") in got
    assert len(got) == neardup.deduplicated(table).count() == 4 and len(got & set(rows[1:3])) == 1
    assert sorted(tuple(r)[:2] for r in neardup.classes(table.where("doc_id is not null")).collect()) == [(2, 2), (5, 2), (5, 2), (5, 5), (9, 9)]


def test_document_counts_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 1 << 18)
    rows = [(i, " ".join(f"w{R.randrange(1 << 30)}" for _ in range(5000))) for i in range(60)] + [(60, None), (61, "x y"), (62, "X  y")]
    rows += [(63, rows[0][1]), (64, rows[0][1] + " end")]
    want = collections.Counter()
    for _, t in rows:
        w = (t or "").lower().split()
        want.update({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ())
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sliced = neardup._sliced(table.select("*", *neardup._keyed(table, "t0", "t1")))
    signed = neardup._signed(sliced, neardup.document_counts(sliced, 2_800_000), len(rows)).collect()
    got = {r["doc_id"]: sorted(np.frombuffer(zlib.decompress(r["df"]), "<u4").tolist()) for r in signed}
    for i, t in rows:
        w = (t or "").lower().split()
        assert got[i] == sorted(want[s] for s in ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else ()))


def test_big_buckets_keep_links(spark, monkeypatch):
    words = prose(300).split()
    rows = []
    for i in range(60):
        own = list(words)
        own[R.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(neardup, "BIG", 8)
    got = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}


def test_near_copies_in_a_larger_group(spark):
    """Copies make each other's shingles common; the weight of the edits, which no other text has, must not part them."""
    draw = random.Random(9)
    base = [f"g{k}" for k in range(3000)]
    rows = []
    for i in range(60):
        own = list(base)
        for k in range(24):
            own[125 * k + draw.randrange(115)] = f"own{i}-{k}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(f"w{draw.randrange(10**6)}" for _ in range(50))) for i in range(60, 460)]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(60)} == {0} and all(got[i] == i for i in range(60, 460))


def brute_repeats(rows, least=50):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        b = (t or "").encode()
        covered, new = bytearray(len(b)), []
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            if w in first:
                covered[s : s + least] = b"\1" * least
            else:
                new.append(w)
        for w in new:
            first.setdefault(w, i)
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeats(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.digest(docs).collect()}
    assert got == brute_repeats([r[:2] for r in corpus()])
    assert repeats.digest(empty).count() == 0
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


@pytest.mark.parametrize("shared", [24, 49, 50])
def test_repeats_of_about_a_passage(spark, shared):
    """Documents that share a gram, but seldom a passage: groups of unequal contexts without a covered window."""
    rows = []
    for k in range(12):
        both = "".join(R.choice("abcdefgh ") for _ in range(shared))
        for i in (2 * k, 2 * k + 1):
            rows.append((i, "".join(R.choice("ijklmnop ") for _ in range(60)) + both + "".join(R.choice("qrstuvwx ") for _ in range(60))))
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows)


def test_repeats_within_documents_only(spark):
    rows = [(i, " ".join(f"{i}-{k % 7}-{i * k % 5}" for k in range(80))) for i in range(20)]
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_repeats(rows) and not any(r[1] for r in got.values())


def test_lcp_intervals_are_all_maximal_groups():
    lcp = [0, 3, 5, 5, 2, 0, 4]
    assert sorted(repeats.lcp_intervals(lcp)) == sorted([(5, 3, 1, 3), (3, 2, 0, 3), (2, 0, 0, 4), (4, 0, 5, 6)])


def test_lm_score(docs, empty):
    got = {r["doc_id"]: r for r in lmscore.scored(docs.where("doc_id is not null")).collect()}
    count, tokens = collections.Counter(), {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, *_ in corpus():
        if i is not None:
            tokens[i] = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) + [None]
            if zlib.crc32(str(i).encode()) % 10:
                count.update(tokens[i])
    total, distinct = sum(count.values()), len(count)
    for i, w in tokens.items():
        base = sum(math.log10((count[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in count for x in w), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert lmscore.scored(empty).count() == 0


def test_lm_weights_are_learned_from_every_training_text(spark):
    """A single text, which a sample by hash would most likely leave out, moves the starting weights and maps."""
    text = " ".join(f"word{k * k % 97}" for k in range(300))
    train = spark.createDataFrame([(1, text, False)], "doc_id long, text string, held_out boolean")
    share = spark.sparkContext.broadcast
    model = np.empty(0, np.uint64), np.empty(0, np.int64), lmscore.byte_codes(np.zeros(65536, np.int64))
    slots = [np.zeros(1 << 12, np.uint16)] * 3
    start, maps = lmscore._fitted(train, "one", share(model), share(slots), (12, 12, 12))
    plain = lmscore.Mixer(slots)
    assert np.abs(maps - plain.maps).max() > 0.01 and np.abs(start - plain.start).max() > 0.001


def slow_bits(text, coder, mixer):
    """Bits of a text, one decision after another in plain Python, from the coder's decisions and the counts' slots."""
    data = np.frombuffer(text.encode().lower(), np.uint8)
    ev = coder.events(data, np.array([0, len(data)]))
    made = coder.decisions(ev, 0, len(ev["row"]))
    total = float(sum(coder.rest[k] for k in ev["known"] if k >= 0))
    sigma = lambda z: 1 / (1 + math.exp(-z))
    for k, kind in enumerate(lmscore.KINDS):
        rows = list(zip(made[kind][1].tolist(), *(s.tolist() for s in made[kind][2:])))
        for a in range(0, len(rows), lmscore.SEGMENT[k]):
            weight, maps, own = mixer.start[k].astype(float).tolist(), mixer.maps[k].astype(float).tolist(), [0.0] * lmscore.ONLINE
            for bit, *slots in rows[a : a + lmscore.SEGMENT[k]]:
                counts = [(int(mixer.slots[c][s]) >> 8, int(mixer.slots[c][s]) & 255) for c, s in enumerate(slots)]
                seen = [0 if sum(n) == 0 else 1 if sum(n) < 8 else 2 for n in counts]
                g, cell = seen[1] * 3 + seen[2], slots[0] % lmscore.ONLINE
                x = [round((math.log((b + 0.3) / (z + 0.3)) + 6.8) * 255 / 13.6) * 13.6 / 255 - 6.8 for z, b in counts]
                x[0] += own[cell]
                dot = max(-5.99, min(5.99, sum(w * v for w, v in zip(weight[g], x))))
                p, at = sigma(dot), int(dot + 6)
                q = maps[g][at]
                one = min(1 - 1e-5, max(1e-5, (p + q) / 2))
                total -= math.log2(one if bit else 1 - one)
                weight[g] = [w + lmscore.RATE * (bit - p) * v for w, v in zip(weight[g], x)]
                maps[g][at] += lmscore.MAP_RATE * (bit - q)
                own[cell] += lmscore.OWN_RATE * (bit - p)
    return total


def test_lm_bits_against_plain_python(monkeypatch):
    monkeypatch.setattr(lmscore, "SEGMENT", (50, 20, 300, 200))
    monkeypatch.setattr(lmscore, "EVENTS", 37)
    texts = [prose(200), "", "x", prose(3) + "\n\n \t" + prose(30), "  " + prose(20) + " \n", "straße \x00 ÉÈ" * 9]
    w = collections.Counter(" ".join(texts).encode().lower().split())
    hashes, counts = {}, {}
    for k, n in w.items():
        d = np.frombuffer(k, np.uint8)
        hashes[k] = lmscore.span_hash(lmscore.prefix_hash(d), np.array([0]), np.array([len(d)]))[0]
        counts[hashes[k]] = n
    known = np.array(sorted(h for h in counts if counts[h] >= 2), np.uint64)
    pairs = np.zeros(65536, np.int64)
    coder = lmscore.Coder(known, np.array([counts[h] for h in known]), lmscore.byte_codes(lmscore._spelling(pairs)), (12, 12, 12))
    g = np.random.default_rng(5)
    mixer = lmscore.Mixer([(g.integers(0, 40, 4096) << 8 | g.integers(0, 40, 4096)).astype(np.uint16) for _ in range(3)])
    data = "".join(texts).encode().lower()
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    ev = coder.events(np.frombuffer(data, np.uint8), offsets)
    parts = [{k: mixer.packed(v) for k, v in coder.decisions(ev, a, b).items()} for a, b in lmscore.stretches(ev)]
    got = sum(mixer.mixed(k, [p[kind] for p in parts], len(texts)) for k, kind in enumerate(lmscore.KINDS))
    got = got + np.bincount(ev["row"], np.append(coder.rest, 0)[ev["known"]], len(texts))
    for t, bits in zip(texts, got):
        assert math.isclose(bits, slow_bits(t, coder, mixer), rel_tol=1e-4)


def test_lm_core_against_numpy_and_plain_python(spark, monkeypatch):
    """The JVM's loop: counts as the decisions of the coder add up, bits as in plain Python, a line a text."""
    from types import SimpleNamespace

    monkeypatch.setattr(lmscore, "SEGMENT", (50, 20, 300, 200))
    texts = [prose(200), "", "x", prose(3) + "\n\n \t" + prose(30), "  " + prose(20) + " \n", "straße \x00 ÉÈ" * 9, "a " * 70000]
    lower = [np.frombuffer(t.encode().lower(), np.uint8) for t in texts]
    w = collections.Counter(" ".join(texts).encode().lower().split())
    hashed = {int(lmscore.span_hash(lmscore.prefix_hash(np.frombuffer(k, np.uint8)), np.array([0]), np.array([len(k)]))[0]): n for k, n in w.items() if n >= 2}
    known = np.array(sorted(hashed), np.uint64)
    model = SimpleNamespace(value=(known, np.array([hashed[int(h)] for h in known]), lmscore.byte_codes(lmscore._spelling(np.zeros(65536, np.int64)))))
    coder = lmscore.Coder(*model.value, (12, 13, 13))
    table = [np.zeros(2 << b, np.int64) for b in (12, 13, 13)]
    for data in lower:
        ev = coder.events(data, np.array([0, len(data)]))
        for _, bit, *slots in coder.decisions(ev, 0, len(ev["row"])).values():
            for t, s in zip(table, slots):
                np.add.at(t, s.astype(np.int64) * 2 + bit, 1)
    assert max(t.max() for t in table) > 65536
    pairs = [t.reshape(-1, 2) for t in table]
    most = [np.maximum(n.max(axis=1, keepdims=True), 255) for n in pairs]
    pairs = [np.where((n > 0) & (m > 255), np.maximum(1, n * 255 // m), n) for n, m in zip(pairs, most)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    slots = lmscore._slots(docs, "core", model, (12, 13, 13))
    assert all(np.array_equal(got, n[:, 0] << 8 | n[:, 1]) for got, n in zip(slots, pairs))
    mixer = lmscore.Mixer(slots)
    rows = lmscore.lmcore.mapped(
        docs.selectExpr("doc_id", "cast(text as binary)", "true as held_out"),
        "row long, doc_id long, held_out boolean, n_tokens long, known long, value double, score double, bits_per_byte double, h array<long>, n array<long>",
        lmscore.lmcore.SCORE, lmscore._model(spark, "core", model, (12, 13, 13)), lmscore._counts(spark, "core", mixer),
        lmscore.lmcore.arrays(spark, mixer.start, mixer.maps, np.zeros(2)),
    ).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert math.isclose(-r["score"] / math.log10(2), slow_bits(t, coder, mixer), rel_tol=1e-4) and r["n_tokens"] == len(t.encode().lower().split()) + 1
        rare = [h for h in coder.events(lower[r["doc_id"]], np.array([0, len(t.encode())]))["h"][:-1].tolist() if h not in hashed]
        assert collections.Counter(rare) == {h % 2**64: n for h, n in zip(r["h"], r["n"])}


def test_lm_counts_pack_and_unpack():
    for x in ([], [0, 1, 254, 255, 256, 70000], [2**40]):
        assert lmscore.whole(lmscore.small(np.array(x, np.int64))).tolist() == x


def test_lm_probabilities_add_up():
    """All strings of a small alphabet up to a length: what the model gives them adds up to 1 at most; each further length adds."""
    w = np.sort(np.array([lmscore.span_hash(lmscore.prefix_hash(np.frombuffer(k, np.uint8)), np.array([0]), np.array([len(k)]))[0] for k in (b"a", b"ab")], np.uint64))
    pairs = np.zeros((256, 256), np.int64)
    for x in (0x20, 0x61, 0x62):
        for y in (0x20, 0x61, 0x62):
            pairs[x, y] = 10**6
    coder = lmscore.Coder(w, np.array([5, 3]), lmscore.byte_codes(lmscore._spelling(pairs.ravel())), (12, 12, 12))
    mixer = lmscore.Mixer([np.full(4096, 3 << 8 | 2, np.uint16)] * 3)
    texts = [""]
    total = 0.0
    for n in range(8):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        ev = coder.events(data, np.arange(len(texts) + 1) * n)
        parts = [{k: mixer.packed(v) for k, v in coder.decisions(ev, a, b).items()} for a, b in lmscore.stretches(ev)]
        bits = sum(mixer.mixed(k, [p[kind] for p in parts], len(texts)) for k, kind in enumerate(lmscore.KINDS))
        total += np.exp2(-(bits + np.bincount(ev["row"], np.append(coder.rest, 0)[ev["known"]], len(texts)))).sum()
        texts = [t + c for t in texts for c in " ab"]
    assert 0.2 < total <= 1 + 1e-6


def vectors(spark, n=300, d=8):
    g = np.random.default_rng(3)
    x = g.normal(size=(n, d)).astype(np.float32)
    x[50:90] = x[0]
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    rows += [(900, None, "c"), (920, [0.0] * d, "c"), (940, [None] + [1.0] * (d - 1), "c"), (960, [float("nan")] * d, "c"), (980, [1.0, 2.0], "c")]
    return x.astype(np.float64), spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string")


def test_top_k(spark):
    x, table = vectors(spark)
    v = topk.integer_vectors(table)
    got = topk.exact_top_k(v, v.where("vec_id % 50 = 0"), 10).collect()
    z = np.floor(1024 * x).astype(np.int64)
    z = np.vstack([z, np.zeros(8, np.int64)])
    ids = np.array([*range(len(x)), 920])
    for q in range(0, 300, 50):
        s = z @ z[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(ids[i], s[i]) for i in order]
    assert topk.exact_top_k(v.limit(0), v.limit(0), 10).count() == 0


def test_threshold_reading_stops_early():
    g = np.random.default_rng(8)
    z = g.integers(-1000, 1000, (2000, 4))
    z[:30] *= 20
    lists, depths = topk.sorted_lists(z), []
    for q in range(0, 60, 2):
        got, score = topk.threshold_search(np.arange(2000), z, z[q], q, 10, lists, depths)
        s = z @ z[q]
        order = [i for i in np.lexsort((np.arange(2000), -s)) if i != q][:10]
        assert got.tolist() == order and score.tolist() == s[order].tolist()
    assert max(depths) < 1000


def test_top_k_of_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (100, [1.0, 2.0]), (0, [2.0, 1.0]), (7, [5.0, 5.0]), (100, [0.5, 0.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.exact_top_k(v, v.where("vec_id = 0 or vec_id = 100"), 10).collect()
    best = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 100)}
    unit = 1024 * 1024
    assert best[0] == [(7, 15 * unit), (100, 5 * unit), (100, unit // 2)] and best[100] == [(7, 5 * unit // 2), (0, unit), (0, unit // 2)]


def test_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (0, [2.0, 1.0]), (3, [0.0, 1.0])]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, F.col("vec_id") % 20 == 0).collect()
    best = {q: [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (0, 20)}
    assert best == {0: [(20, 5.0), (3, 2.0)], 20: [(0, 5.0), (0, 4.0), (3, 2.0)]}


def test_neighbours_of_outliers(spark, monkeypatch):
    """Vectors that share no bucket with others, and clusters without a way out, still get all their neighbours."""
    monkeypatch.setattr(neighbours, "CHUNK", 4)
    monkeypatch.setattr(neighbours, "DEGREE", 3)
    monkeypatch.setattr(neighbours, "BEAM", 8)
    g = np.random.default_rng(2)
    x = np.concatenate([g.normal(size=(60, 6)) * 0.01 + np.eye(6)[i % 6] * (1 - 2 * (i % 2)) for i in range(6)]).astype(np.float32)
    x[0] = [-50, 50, -50, 50, -50, 50]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(table, 5, F.col("vec_id") % 20 == 0).collect()
    assert all(sum(r["query_id"] == q for r in got) == 5 for q in range(0, 360, 20))
    short = table.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding as qe")
    whole = neighbours.exact(short, table, 5).collect()
    for q in range(0, 360, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        assert {r["vec_id"] for r in whole if r["query_id"] == q} == set(np.lexsort((np.arange(360), -s))[:5])


def test_neighbours(spark):
    x, table = vectors(spark)
    got = neighbours.nearest(table, 20, F.col("vec_id") % 20 == 0).collect()
    assert not {r["query_id"] for r in got} & {900, 920, 940, 960}
    hit = 0
    for q in range(0, 300, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        hit += len(set(order) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit >= 0.95 * 15 * 20
    assert neighbours.nearest(table.limit(0), 20, F.lit(True)).count() == 0


def test_url_filter(spark):
    urls = [None, "nothing", "http://A.example.com/en/x?q#f", "https://www.example.com/en/1", "http://b.net/es/", "http://b.net/es", "http://bad.org/x/", "http://www.bad.org/x#y", "http://ok.org/x", "http://com", "s://com/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")], "host string, path string, verdict string")
    listed = spark.createDataFrame([("bad.org/x",), (None,)], "url_key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judged(pages, rules, listed).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block") and got[3][2:] == ("www.example.com/en/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5][2:] == (None, "allow")
    assert got[6][3] == got[7][3] == "block" and got[8][3] == "allow" and got[9][2:] == (None, "allow") and got[10][2:] == ("com/", "allow")


def test_url_filter_with_a_full_filter(spark, monkeypatch):
    """A filter so small that it lets nearly everything through changes no verdict; nor does the join's kind."""
    hosts = [f"h{k % 40}.{'com net org'.split()[k % 3]}" for k in range(400)]
    pages = spark.createDataFrame([(i, f"http://www.{h}/p{i % 7}/x{i % 11}/") for i, h in enumerate(hosts)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{k}.com/p{k % 7}/x{k % 11}",) for k in range(0, 300)] + [("h9.com/p2/x9",)], "url_key string")
    rules = spark.createDataFrame([("com", "/p1/", "allow"), ("h3.com", "/", "block"), ("org", "/p2/x2/", "block"), ("h5.org", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    want = sorted(map(tuple, urlfilter.judged(pages, rules, listed).collect()))
    keys = {r["url_key"] for r in listed.collect()}
    for i, host, path, rule, verdict in want:
        fit = [(h + p, v) for h, p, v in [("com", "/p1/", "allow"), ("h3.com", "/", "block"), ("org", "/p2/x2/", "block"), ("h5.org", "/", "allow")] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda f: len(f[0])) if fit else (None, "block" if host.removeprefix("www.") + path.rstrip("/") in keys else "allow")
        assert (rule, verdict) == best
    monkeypatch.setattr(urlfilter, "MAX_BLOCKS", 1)
    monkeypatch.setattr(urlfilter, "FEW_RULES", 0)
    assert sorted(map(tuple, urlfilter.judged(pages, rules, listed).collect())) == want


def test_near_duplicates_against_all_pairs(spark):
    """Recall of pairs at the threshold, by weighted Jaccard over all pairs of queries and documents."""
    texts = []
    for _ in range(30):
        base = prose(R.randrange(30, 200)).split()
        for k in range(4):
            own = list(base)
            for _ in range(k):
                own[R.randrange(len(own))] = f"edit{R.randrange(10**6)}"
            texts.append(" ".join(own))
    R.shuffle(texts)
    features = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in (t.lower().split() for t in texts)]
    df = collections.Counter(s for f in features for s in f)
    weight = [{s: n * math.log1p(len(texts) / (1 + df[s])) for s, n in f.items()} for f in features]
    near = lambda a, b: sum(min(a[s], b[s]) for s in a.keys() & b) / (sum(a.values()) + sum(b.values()) - sum(min(a[s], b[s]) for s in a.keys() & b))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near(weight[i], weight[j]) >= 0.8]
    assert len(pairs) > 20 and sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    links: dict[int, set] = {i: {i} for i in range(len(texts))}
    for i, j in pairs:
        if links[i] is not links[j]:
            links[i] |= links[j]
            for k in links[j]:
                links[k] = links[i]
    assert all(got[i] in links[i] for i in range(len(texts)))  # nothing else is joined


def test_threads_against_a_plain_linker(spark):
    r, rows = random.Random(6), []
    for conv in range(12):
        said = []
        for turn in range(10):
            own = [f"{conv}-{turn} " + " ".join(r.choice(WORDS[:10]) for _ in range(6)) for _ in range(r.randrange(1, 4))]
            lines, parent = [], None
            if said and r.random() < 0.8:
                parent = r.randrange(len(said))
                lines = ["On Monday somebody wrote:"] + ["> " + x.replace(" ", "  ").upper() for x in said[parent][0]]
                if said[parent][1] is not None:
                    lines += [">> " + x for x in said[said[parent][1]][0]]
            rows.append((conv, turn, "u", "\n".join(lines + ["", *own])))
            said.append((own, parent))
            rows[-1] = (*rows[-1], parent)
    got = {(x["conv_id"], x["turn"]): x for x in quotes.linked(spark.createDataFrame([x[:4] for x in rows], "conv_id long, turn long, role string, text string")).collect()}
    parents = {(c, t): p for c, t, _, _, p in rows}
    for (c, t), p in parents.items():
        root = t
        while parents[c, root] is not None:
            root = parents[c, root]
        assert got[c, t]["parent_turn"] == p and got[c, t]["root_turn"] == root and ">" not in got[c, t]["text"]
    for c in range(12):
        order = sorted(range(10), key=lambda t: (got[c, t]["root_turn"], t))
        assert [got[c, t]["position"] for t in order] == list(range(1, 11))


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there.\n\nSecond  part."), (1, 1, "b", "Other topic"), (1, 2, "c", "On Monday a wrote:\n> second part.\nI agree."),
        (1, 3, "d", "> > Second part.\n> I agree.\nMe too"), (1, 4, "e", "> unknown\nfine"), (2, 0, "a", None), (None, None, "a", "> x"), (2, 0, "a", None),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 2]["parent_turn"] == 0 and got[1, 2]["text"] == "I agree." and got[1, 3]["parent_turn"] == 2 and got[1, 3]["root_turn"] == 0
    assert got[1, 4]["parent_turn"] is None and got[1, 4]["text"] == "fine"
    assert [got[1, t]["position"] for t in range(5)] == [1, 4, 2, 3, 5]
