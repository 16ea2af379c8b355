"""Token patterns: sequences of token tests with repeat marks, matched sentence by sentence without a shuffle.

A pack is a list of rules {name, label, patterns, meta}; a pattern is a list of steps {ATTRIBUTE: value, OP: mark}.
Attributes: LOWER, LEMMA, TEXT, ORTH, LIKE_NUM, IS_PUNCT, IS_TITLE, IS_ALPHA, IS_ASCII, IS_DIGIT; a value is a scalar,
{IN: [...]}, {NOT_IN: [...]} or {REGEX: ...}; marks are ?, +, * and !. Lemmas stand for their regular endings. A pattern
with another attribute needs a tagger: it is left out and named by `unsupported`.
"""

from __future__ import annotations

import json

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import inflections

TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\r\n]"
#: Number words that count as numbers.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
FLAGS = {
    "LIKE_NUM": lambda t: bool(regex.fullmatch(r"[0-9]+(?:[.,/][0-9]+)*", t)) or t.lower() in NUMBER_WORDS,
    "IS_PUNCT": lambda t: bool(regex.fullmatch(r"\p{P}+", t)),
    "IS_TITLE": str.istitle,
    "IS_ALPHA": str.isalpha,
    "IS_ASCII": str.isascii,
    "IS_DIGIT": str.isdigit,
}
TEXTS = {"LOWER": str.lower, "LEMMA": str.lower, "TEXT": str, "ORTH": str}
#: Tokens whose tests a task remembers at a time.
MEMO = 1 << 16


def load_pack(spark: SparkSession, path: str) -> list[dict]:
    """The rules of a JSON file, read by Spark so that any store works; a pack is small and lives on the driver."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def _known(pattern: list[dict]) -> bool:
    return all(key in FLAGS or key in TEXTS or key == "OP" for step in pattern for key in step)


def unsupported(pack: list[dict]) -> list[tuple[str, int]]:
    """(rule, number of the pattern) of what needs a tagger."""
    return [(rule["name"], i) for rule in pack for i, pattern in enumerate(rule["patterns"]) if not _known(pattern)]


def _forms(attribute: str, words: list[str]) -> frozenset:
    return frozenset(form for w in words for form in (inflections(w) if attribute == "LEMMA" else [w]))


def _test(attribute: str, value):
    """A predicate on one token."""
    if attribute in FLAGS:
        return lambda t: FLAGS[attribute](t) == bool(value)
    shape = TEXTS[attribute]
    if not isinstance(value, dict):
        value = {"IN": [value]}
    checks = []
    for kind, operand in value.items():
        if kind == "REGEX":
            checks.append(lambda t, find=regex.compile(operand).search: find(shape(t)) is not None)
        elif kind in ("IN", "NOT_IN"):
            checks.append(lambda t, forms=_forms(attribute, operand), want=kind == "IN": (shape(t) in forms) == want)
        else:
            raise ValueError(f"unknown value {kind}")
    return lambda t: all(check(t) for check in checks)


class Matcher:
    """All spans (rule, start, end) of a pack over a list of tokens: every match, each span once a rule."""

    def __init__(self, pack: list[dict]):
        self.tests, self.memo, bits = [], {}, {}
        self.rules = []
        for rule in pack:
            for pattern in filter(_known, rule["patterns"]):
                steps = []
                for step in pattern:
                    wanted = 0
                    for attribute, value in step.items():
                        if attribute != "OP":
                            key = json.dumps([attribute, value], sort_keys=True)
                            if key not in bits:
                                bits[key] = len(self.tests)
                                self.tests.append(_test(attribute, value))
                            wanted |= 1 << bits[key]
                    steps.append((wanted, step.get("OP", "1")))
                self.rules.append((rule["name"], steps))

    def mask(self, token: str) -> int:
        """One bit for each test that the token meets."""
        if (found := self.memo.get(token)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[token] = sum(1 << i for i, test in enumerate(self.tests) if test(token))
        return found

    @staticmethod
    def _open(states: set[int], steps: list) -> set[int]:
        """The states with those that optional steps let through."""
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                if s < len(steps) and steps[s][1] in "?*":
                    todo.append(s + 1)
        return out

    def spans(self, tokens: list[str]) -> set[tuple[str, int, int]]:
        masks, out = [self.mask(t) for t in tokens], set()
        for name, steps in self.rules:
            first = self._open({0}, steps)
            for start in range(len(tokens)):
                states, at = first, start
                while states and at < len(tokens):
                    after = set()
                    for s in states:
                        if s < len(steps):
                            wanted, op = steps[s]
                            if ((masks[at] & wanted) == wanted) != (op == "!"):
                                after.add(s + 1)
                                if op in "+*":
                                    after.add(s)
                    states, at = self._open(after, steps), at + 1
                    if len(steps) in states:
                        out.add((name, start, at))
        return out


def pattern_hits(sentences: DataFrame, pack: list[dict]) -> DataFrame:
    """(doc_id, sent_idx, rule, label, start, end): spans in tokens of rules that hold in the sentence's section.

    sentences: doc_id, sent_idx, section, text; a null text has no hits. A rule without sections holds everywhere.
    """
    label = {rule["name"]: rule["label"] for rule in pack}
    gates = {rule["name"]: {s.upper() for s in rule.get("meta", {}).get("sections", [])} for rule in pack}
    key = sentences.schema["doc_id"].dataType.simpleString()

    def match(frames):
        matcher, split = Matcher(pack), regex.compile(TOKEN).findall
        for frame in frames:
            rows = []
            for doc_id, sent_idx, section, text in zip(frame["doc_id"], frame["sent_idx"], frame["section"], frame["text"]):
                for name, start, end in sorted(matcher.spans(split(text or ""))):
                    if not gates[name] or (section or "").upper() in gates[name]:
                        rows.append((doc_id, sent_idx, name, label[name], start, end))
            yield pd.DataFrame(rows, columns=["doc_id", "sent_idx", "rule", "label", "start", "end"])

    return sentences.select("doc_id", "sent_idx", "section", "text").mapInPandas(match, f"doc_id {key}, sent_idx int, rule string, label string, start int, end int")


def hit_counts(hits: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, rule, label, hits), the form that scores are built on."""
    return hits.groupBy("doc_id", "sent_idx", "rule", "label").agg(F.count("*").alias("hits"))
