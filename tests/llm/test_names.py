"""Extra columns, whatever their names, come through every operator that returns whole rows as they went in."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import langid, mixing, neardup, quotes, repeats, rows

HERE = Path(rows.__file__).parent
WORDS = "der die das und ist nicht ein schön über heute morgen Haus Baum geht kommt".split()


def names():
    """Every name that the operators' sources quote."""
    found = set()
    for module in ("langid", "mixing", "neardup", "repeats", "rows"):
        found |= set(re.findall(r"[\"']([a-z_][a-z_0-9]*)[\"']", (HERE / f"{module}.py").read_text()))
        found |= set(re.findall(r"\b([a-z_0-9]+)=F\.", (HERE / f"{module}.py").read_text()))
    return sorted(found - {"doc_id", "text", "lang", "source", "n_chars"})


def table(spark):
    texts = [" ".join(WORDS[(i * k) % 15] for k in range(3, 60)) for i in range(1, 9)]
    texts += [texts[0], texts[1] + " Ende", None, "", "12", "x"]
    made = spark.createDataFrame([(i if i % 5 else None, t, "de" if i % 3 else None, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    key = F.concat_ws("/", F.coalesce("doc_id", F.lit(-1)), F.coalesce(F.xxhash64("text"), F.lit(0)))
    return made.select("*", F.length("text").cast("long").alias("n_chars"), *[F.concat(F.lit(f"{n}:"), key).alias(n) for n in names()])


@pytest.mark.parametrize("operator", ["without_rejects", "deduplicated", "without_repeats", "resampled"])
def test_columns_come_through(spark, operator):
    docs = table(spark)
    run = {
        "without_rejects": lambda d: langid.without_rejects(d, d), "deduplicated": neardup.deduplicated,
        "without_repeats": repeats.without_repeats, "resampled": mixing.resampled,
    }[operator]
    got = run(docs)
    assert got.schema == docs.schema or [f.dataType for f in got.schema] == [f.dataType for f in docs.schema] and got.columns == docs.columns
    extra = names()
    before = {tuple(r[n] for n in extra) for r in docs.collect()}
    after = [tuple(r[n] for n in extra) for r in got.collect()]
    assert len(extra) > 30 and after and set(after) <= before
    assert all(r[0].split(":")[1] == x.split(":", 1)[1] for r in after for x in r)


def test_quotes_do_not_read_other_columns(spark):
    made = spark.createDataFrame([(1, 0, "a", "Hello", "x", "y"), (1, 1, "b", "> hello\nyes", "x", "y")], "conv_id long, turn long, role string, text string, key string, root string")
    assert [r["parent_turn"] for r in quotes.linked(made).orderBy("turn").collect()] == [None, 0]
