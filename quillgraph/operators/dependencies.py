"""Dependency patterns over a given parse: tokens with the place of their head.

A pattern is a list of steps {NAME, ABOVE, OP, attributes}: the first is an anchor, each other a token below (at any
depth) the one that ABOVE names. A step with OP ? may be missing. A parse is an input here, as pages are to the layout.

A sentence's tokens are matched within one row, each step's tokens walking up their heads, so that no pairs of tokens
are written or shuffled; only matches are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["doc_id", "sent_idx"]


def above(heads: dict[int, set[int]], i: int) -> set[int]:
    """All tokens above i; a root is its own head, or has none."""
    found, open_ = set(), [i]
    while open_:
        more = heads.get(open_.pop(), set()) - found
        found |= more
        open_ += more
    return found


def matches(heads: dict[int, set[int]], steps: list[dict], fits: list[list[int]]) -> set[tuple[int, ...]]:
    """Places of distinct tokens that match the steps; fits: the tokens that each step's attributes allow."""
    names = [s["NAME"] for s in steps]
    rows = [(i,) for i in set(fits[0])]
    for step, own in zip(steps[1:], fits[1:]):
        if not rows:
            break
        at = names.index(step["ABOVE"])
        by = defaultdict(list)
        for row in rows:
            by[row[at]].append(row)
        rows = [(*row, i) for i in set(own) for a in above(heads, i) if a in by for row in by[a]]
    return {tuple(sorted(row)) for row in rows if len(set(row)) == len(steps)}


def expanded(pattern: list[dict]) -> list[list[dict]]:
    """A pattern for each choice of its optional steps; one whose missing step others hang on is left out."""
    out = []
    for taken in product(*[(False, True) if s.get("OP") == "?" else (True,) for s in pattern]):
        steps = [s for s, t in zip(pattern, taken) if t]
        names = {s["NAME"] for s in steps}
        if steps and "ABOVE" not in steps[0] and all(s["ABOVE"] in names for s in steps[1:]):
            out.append(steps)
    return out


def _fits(step: dict, token: Callable[[str], Column]) -> Column:
    test = F.lit(True)
    for attribute, value in step.items():
        if attribute not in ("NAME", "ABOVE", "OP"):
            wanted = value["IN"] if isinstance(value, dict) else [value]
            test = test & token(attribute.lower()).isin(*wanted)
    return test


def parsed(tokens: DataFrame, pack: list[dict]) -> DataFrame:
    """tokens (doc_id, sent_idx, i, head, attributes) as (doc_id, sent_idx, parse array<struct<i,head,attributes>>)."""
    tested = {a.lower() for rule in pack for pattern in rule["patterns"] for step in pattern for a in step} - {"name", "above", "op"}
    return tokens.groupBy(*KEY).agg(F.collect_list(F.struct("i", "head", *sorted(tested - {"i", "head"}))).alias("parse"))


def parse_hits(parses: DataFrame, pack: list[dict]) -> DataFrame:
    """dependency_hits of sentences whose tokens are in a row: (doc_id, sent_idx, parse array<struct<i,head,attributes>>)."""
    todo, steps_of = [], []
    for rule in pack:
        for pattern in rule["patterns"]:
            for steps in expanded(pattern):
                bare = [{a: v for a, v in s.items() if a not in ("NAME", "ABOVE", "OP")} for s in steps]
                steps_of += [s for k, s in enumerate(bare) if s not in steps_of and s not in bare[:k]]
                todo.append((rule["name"], rule["label"], steps, [steps_of.index(s) for s in bare]))
    place = lambda x: x["i"].cast("int")
    of = lambda step: F.transform(F.filter("parse", lambda x: _fits(step, lambda a: x[a])), place)
    fits = [of(step).alias(f"fits{k}") for k, step in enumerate(steps_of)]
    rows = parses.select(*KEY, F.transform("parse", place).alias("i"), F.transform("parse", lambda x: x["head"].cast("int")).alias("head"), *fits)

    def run(batches):
        for batch in batches:
            cols = [batch.column(c) for c in range(2, batch.num_columns)]
            cuts = [c.offsets.to_numpy() for c in cols]
            flat = [c.values.to_pylist() for c in cols[2:]]
            some = [np.diff(c) > 0 for c in cuts[2:]]
            at_of = lambda k, r: flat[k][cuts[k + 2][r] : cuts[k + 2][r + 1]]
            keyed = np.array(batch.column(0).is_valid()) & np.array(batch.column(1).is_valid())
            row, rules, labels, found = [], [], [], []
            parse: dict[int, dict] = {}
            for name, label, steps, at in todo:
                live = np.logical_and.reduce([some[k] for k in at])
                for r in np.flatnonzero(live if len(steps) == 1 else live & keyed).tolist():
                    if r not in parse:
                        heads = parse[r] = defaultdict(set)
                        pair = [c.values[int(cut[r]) : int(cut[r + 1])].to_pylist() for c, cut in zip(cols[:2], cuts[:2])]
                        for i, head in zip(*pair):
                            if i is not None and head is not None and i != head:
                                heads[i].add(head)
                    for places in matches(parse[r], steps, [[i for i in at_of(k, r) if i is not None] for k in at]):
                        row.append(r)
                        rules.append(name)
                        labels.append(label)
                        found.append(places)
            keys = [batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(rules, pa.string()), pa.array(labels, pa.string()), pa.array(found, pa.list_(pa.int32()))], [*KEY, "rule", "label", "at"])

    kinds = [f"{k} {parses.schema[k].dataType.simpleString()}" for k in KEY]
    found = rows.mapInArrow(run, ", ".join([*kinds, "rule string", "label string", "at array<int>"]))
    return found.distinct().groupBy(*KEY, "rule", "label").agg(F.count("*").alias("matches"), F.sum(F.size("at")).alias("tokens"))


def dependency_hits(tokens: DataFrame, pack: list[dict]) -> DataFrame:
    """(doc_id, sent_idx, rule, label, matches, tokens): tokens (doc_id, sent_idx, i, head, and a column for each attribute
    that the rules test); matches of a rule and the tokens in them, which scores weigh. Steps are distinct tokens."""
    return parse_hits(parsed(tokens, pack), pack)
