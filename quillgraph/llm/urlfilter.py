"""URL filter: a blocked Bloom filter lets possible hits through to an exact hash join.

Two kinds of listed keys share one filter: listed canonical URLs, and rules (host, path, verdict). A url has
one candidate key for its canonical form and one for each (parent domain, path prefix) whose prefix length
some rule has. Only candidates that the filter may hold are joined with the lists; the join removes the false
positives. The longest fitting rule decides; else a listed url is blocked and any other allowed.

The filter is 256-bit blocks; a key sets one bit in each of the eight 32-bit words of its block. Its size
follows the number of keys up to MAX_BLOCKS (32 MB), which bounds what is broadcast; beyond that only the
number of false positives grows, never the result.

Rules are few as a rule: up to FEW_RULES of them are joined by broadcast, apart from the listed urls, so that a rule that
half of all urls fit is no hot key. Rows are numbered in a written table, so that a verdict finds its row again after a
lost executor.

Defined results: a null url or one without :// has empty host and path, fits no rule and is allowed; repeated
rows are judged each; two rules with the same host and path count once, block before allow; of two rules of equal length
that both fit the one with the longer host decides; a rule or listed url that is null is none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.store import written

BITS_PER_KEY = 16
MAX_BLOCKS = 1 << 20
WORDS = 8
FEW_RULES = 20_000
#: Odd multipliers, one for each word of a block.
SALT = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint32)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without leading www., path without trailing slashes; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.lit("/"), F.regexp_replace(path, r"^/|/+$", ""))


def _block_bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For 64-bit hashes: the block of each, and its bit mask in each word of the block."""
    h = hashes.astype(np.int64).view(np.uint64)
    block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
    bit = (h.astype(np.uint32)[:, None] * SALT[None, :]) >> np.uint32(27)
    return block, np.uint32(1) << bit


class BlockedBloom:
    def __init__(self, keys: DataFrame, column: str) -> None:
        """Built from the distinct keys: bits are set per partition and or-ed by block before they come here."""
        n = keys.count()
        self.blocks = blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_PER_KEY // 256)))

        def partial(batches):
            table: dict[int, np.ndarray] = {}
            for pdf in batches:
                for b, m in zip(*_block_bits(pdf["h"].to_numpy(), blocks)):
                    table[b] = table[b] | m if b in table else m
            if table:
                yield pd.DataFrame([[b, *map(int, m)] for b, m in table.items()], columns=["b", *(f"w{i}" for i in range(WORDS))])

        rows = (
            keys.select(F.xxhash64(column).alias("h"))
            .mapInPandas(partial, "b long, " + ", ".join(f"w{i} long" for i in range(WORDS)))
            .groupBy("b")
            .agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
            .collect()  # at most MAX_BLOCKS rows
        )
        bits = np.zeros((blocks, WORDS), np.uint32)
        for row in rows:
            bits[row[0]] = row[1:]
        self.shared = keys.sparkSession.sparkContext.broadcast(bits)

    def may_hold(self, key: Column) -> Column:
        shared, blocks = self.shared, self.blocks

        @F.pandas_udf(T.BooleanType())
        def test(h: pd.Series) -> pd.Series:
            block, mask = _block_bits(h.to_numpy(), blocks)
            return pd.Series(((shared.value[block] & mask) == mask).all(axis=1))

        return test(F.xxhash64(key))


def judged(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """pages(page_id, url), rules(host, path, verdict), listed(url_key): page_id, host, path, rule, verdict."""
    rules = rules.groupBy(F.concat("host", "path").alias("rule"), F.length("path").alias("n"), F.length("host").alias("wide")).agg(
        F.max("verdict").alias("says")  # 'block' is after 'allow'
    ).where("rule is not null")
    rules = written(rules, "rules")
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())  # path lengths, no more than a url is long
    listed = written(listed.select(F.concat(F.lit("u:"), "url_key").alias("k")).where("k is not null").distinct(), "listed")
    keyed = rules.select(F.concat(F.lit("r:"), "rule").alias("k"), "rule", "says", "wide")
    bloom = BlockedBloom(keyed.select("k").unionByName(listed), "k")
    seen = written(pages.select("page_id", F.monotonically_increasing_id().alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "urls")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths] or [F.lit(None).cast("string")]))
    ruled = F.array_distinct(F.flatten(F.transform(parents, lambda d: F.transform(prefixes, lambda p: F.concat(F.lit("r:"), d, p)))))
    hosted = seen.where("host <> ''")
    passed = lambda keys: hosted.select("row", F.explode(keys).alias("k")).where(bloom.may_hold(F.col("k")))
    few = rules.count() <= FEW_RULES
    fits = passed(ruled).join(F.broadcast(keyed) if few else keyed, "k").groupBy("row").agg(F.max_by(F.struct("rule", "says"), F.struct(F.length("rule"), "wide", "rule")).alias("b"))
    blocked = passed(F.array(F.concat(F.lit("u:"), canonical(F.col("host"), F.col("path"))))).join(listed, "k", "left_semi").select(F.col("row").alias("hit"))
    return seen.join(fits, "row", "left").join(blocked, F.col("row") == F.col("hit"), "left").select(
        "page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce(F.col("b.says"), F.when(F.col("hit").isNotNull(), "block"), F.lit("allow")).alias("verdict")
    )
