"""Each stage, and the whole run, on small tables with nulls, repeats and nothing."""

import collections
import random

import pytest

import corpus_pipeline

R = random.Random(12)
DE = "der die das und ist nicht ein schön über heute morgen Haus Baum geht kommt wieder Garten Straße Wasser".split()
FR = "le la les est pas une été où ça maison arbre demain encore jardin rue eau vient monde petit grand".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(words, n):
    return " ".join(R.choice(words) for _ in range(n))


def _rows():
    same, passage = prose(DE, 80), prose(FR, 25)
    texts = [(i, prose(DE if i % 2 else FR, R.randrange(20, 120)), "de" if i % 2 else "fr") for i in range(40)]
    texts += [(50, same, "de"), (51, same, None), (52, same + " Ende", "de"), (None, same, "de"), (None, None, None), (53, "", "fr"), (54, "12 34", "de"), (55, "é", None)]
    texts += [(60, prose(FR, 30) + " " + passage + " " + prose(FR, 30), "fr"), (61, prose(FR, 30) + " " + passage + " " + prose(FR, 30), "fr"), (61, prose(FR, 40), "fr")]
    texts += [(70, "это совсем другой язык и буквы другие " * 9, None)]
    return [(i, t, lang, [None, "a", "b"][k % 3], len(t or "")) for k, (i, t, lang) in enumerate(texts)]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def test_stages_keep_columns_and_take_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, "")
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0


def test_language_drops_what_has_none(spark, docs):
    got = {(r["doc_id"], r["text"]): r["lang"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    want = {(r[0], r[1]) for r in ROWS if r[0] not in (53, 54, 70) and r[1] is not None}
    assert set(got) == want and got[51, ROWS[41][1]] == "de" and all(got.values())


def test_near_duplicates_keeps_one_of_each(spark, docs):
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    ids = [i for i, _ in got]
    assert 50 in ids and not {51, 52} & set(ids) and len(got) == len(set(got)) and {i for i in range(40)} <= set(ids)
    assert collections.Counter(ids)[61] == 2  # different texts under one id both stay


def test_repeated_passages_leave_the_first(spark, docs):
    got = {(r["doc_id"], r["n_chars"]): r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").where("doc_id in (60, 61)").collect()}
    first = next(t for (i, _), t in got.items() if i == 60)
    assert first == next(r[1] for r in ROWS if r[0] == 60)
    assert all(n == len(t) for (i, n), t in got.items()) and any(i == 61 and len(t) < len(first) for (i, _), t in got.items())


def test_run_packs_each_copy_whole(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = collections.Counter()
    for r in got:
        tokens[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert got and all(n % size == 0 for (_, size), n in tokens.items())
    ids = {r["doc_id"] for r in got}
    assert not ids & {51, 52, 53, 54, 70}
