"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels (leading '>' signs, nested by number); lines of one level that
follow each other are a quoted passage, the rest is the message's own text. Passages are normalised (lower case,
white space collapsed) and hashed, whole, by paragraph and by line, and joined to the first message of the
conversation whose own text has a whole text, paragraph or line with that hash. A message replies to the original
of its shallowest linked quote (the longest match of that level). Conversations are put in reply order: a thread
(messages linked by quotes) stands where its first message stands, in order of turns, without quotes.

Only conversations with a quote send keys through the shuffle; each key is reduced to its first message before
the join, so a line that everyone writes joins one row.

Defined results: null text stays null, has no quotes and links nothing; a quote without an original is removed
but not linked; an original must have a smaller turn; null conv_id or turn links nothing; repeated rows get the
same links and neighbouring positions; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.store import dropped, written

LEVELS = re.compile(r"^[ \t]*((?:>[ \t]*)+)")
#: Lines that announce a quote.
ATTRIBUTION = re.compile(r"(?:wrote|écrit|schrieb|escribió)\s*:\s*$", re.IGNORECASE)
PARSED = T.StructType([
    T.StructField("own", T.StringType()),
    T.StructField("quotes", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType())]))),
])


def parsed(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text, [(level, passage)])."""
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        found = LEVELS.match(line)
        level = found.group(1).count(">") if found else 0
        if not level:
            own.append(line)
        else:
            if not before and own and ATTRIBUTION.search(own[-1]):
                own.pop()
            if before == level:
                quotes[-1][1].append(line[found.end():])
            else:
                quotes.append((level, [line[found.end():]]))
        before = level
    return "\n".join(own).strip("\n"), [(n, "\n".join(lines)) for n, lines in quotes]


@F.pandas_udf(PARSED)
def _parse(texts: pd.Series) -> pd.DataFrame:
    rows = [parsed(t) for t in texts]
    return pd.DataFrame({"own": [r[0] for r in rows], "quotes": [[{"level": n, "text": x} for n, x in r[1]] for r in rows]})


def _keys(text):
    """Distinct normalised whole text, paragraphs and lines."""
    parts = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, r"\n"))
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.lower(p), r"\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda p: F.length(p) > 0))


def linked(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (own), n_quotes, parent_turn, root_turn, position (from 1 in its conversation)."""
    quoting = F.col("text").rlike(r"(?m)^[ \t]*>")
    rows = messages.select("conv_id", "turn", "role", "text")
    some = rows.where(quoting).withColumn("p", _parse("text")).select("conv_id", "turn", "role", F.col("p.own").alias("text"), F.col("p.quotes").alias("quotes"))
    rest = rows.where(~F.coalesce(quoting, F.lit(False))).withColumn("quotes", F.lit(None).cast(some.schema["quotes"].dataType))
    rows = written(some.unionByName(rest), "messages")
    quotes = rows.where("quotes is not null").select("conv_id", "turn", F.explode("quotes").alias("q")).select(
        "conv_id", "turn", F.col("q.level").alias("level"), F.explode(_keys(F.col("q.text"))).alias("key")
    ).select("conv_id", "turn", "level", F.length("key").alias("n"), F.xxhash64("key").alias("key"), F.md5("key").alias("key2"))
    busy = rows.where("quotes is not null").select("conv_id").distinct()
    firsts = (
        rows.join(busy, "conv_id", "left_semi")
        .select("conv_id", "turn", F.explode(_keys(F.col("text"))).alias("key"))
        .groupBy("conv_id", F.xxhash64("key").alias("key"), F.md5("key").alias("key2"))
        .agg(F.min("turn").alias("origin"))
    )
    best = F.max_by("origin", F.struct(-F.col("level"), F.col("n"), F.col("origin")))
    links = written(
        quotes.join(firsts, ["conv_id", "key", "key2"]).where(F.col("origin") < F.col("turn")).groupBy("conv_id", "turn").agg(best.alias("parent")), "links"
    )
    # Roots by pointer jumping: each round doubles the distance covered.
    roots, own = links.select("conv_id", "turn", F.col("parent").alias("root")), False
    while True:
        up = roots.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        new = written(roots.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "roots")
        if own:  # the first are the links, which are read again
            dropped(roots)
        roots, own = new.select("conv_id", "turn", "root"), True
        if not new.where("moved").limit(1).count():
            break
    known = links.join(roots, ["conv_id", "turn"])
    out = rows.join(known, ["conv_id", "turn"], "left").withColumn("root", F.coalesce("root", "turn"))
    order = Window.partitionBy("conv_id").orderBy("root", "turn", "role", "text")
    return out.select(
        "conv_id", "turn", "role", "text", F.coalesce(F.size("quotes"), F.lit(0)).alias("n_quotes"),
        F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), F.row_number().over(order).alias("position"),
    )
