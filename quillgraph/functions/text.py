"""Column functions on text. Patterns keep to what Java and RE2 read alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.plans import dims

# What counts as a citation, a number of note, a reference's line, and a mark of a figure or table.
CITE_AUTHOR = r"\([A-Z][a-zA-Z-]+(?:\s+et\s+al\.)?(?:\s*&\s*[A-Z][a-zA-Z-]+)?,?\s*[0-9]{4}[a-z]?\)"
CITE_NUMBER = r"\[[0-9]+(?:\s*[-–]\s*[0-9]+)?(?:\s*,\s*[0-9]+)*\]"
NOT_CITE = r"(?i)\((?:n\s*=\s*[0-9]+|p\s*[<≤]\s*0\.[0-9]+|Fig\.|Table|Eq\.)"
NUMERIC_HINT = r"(?iU)(?:\b[0-9]+(?:\.[0-9]+)?\s?%|\bby\s+[0-9]+(?:\.[0-9]+)?\b|\bp\s*[<≤]\s*0\.0[1-5]\b|\bAUC\b|\bRMSE\b)"
REFERENCE_WORD = r"(?iU)\b(?:vol\.?|no\.?|pp\.?|doi:?|issn|et al\.)\b"
YEAR = r"(?U)\b(?:19|20)[0-9]{2}\b"
PAGES = r"(?U)\b[0-9]{1,4}\s*[–-]\s*[0-9]{1,4}\b"
FIGURE, TABLE = r"(?i)\b(?:Fig\.|Figure)\s*([IVXLC0-9]+)\b", r"(?i)\bTable\s*([IVXLC0-9]+)\b"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9]+"), F.lit(0))


def has_numeric(text: Column) -> Column:
    return text.rlike("[0-9]") | text.contains("%") | F.lower(text).contains(" p<") | F.lower(text).contains(" p =")


def looks_like_reference(text: Column) -> Column:
    return (F.length(text) >= 30) & (text.rlike(REFERENCE_WORD) | (text.rlike(YEAR) & text.rlike(PAGES)))


def citation_strength(text: Column) -> Column:
    number = text.rlike(CITE_NUMBER)
    return F.when(text.rlike(NOT_CITE), F.when(number, 0.5).otherwise(0.0)).when(text.rlike(CITE_AUTHOR), 0.7).when(number, 0.5).otherwise(0.0)


def citation_heavy(text: Column) -> Column:
    n = F.regexp_count(text, F.lit(CITE_AUTHOR)) + F.regexp_count(text, F.lit(CITE_NUMBER))
    return (n >= 2) | ((n >= 1) & (F.length(text) < 120))


def edge_tokens(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in dims.STOPWORDS])
    return F.array_except(F.filter(F.array_distinct(tokens(text)), lambda t: F.length(t) > 2), stop)


def references(text: Column) -> Column:
    """Figure and table marks such as F2 or TIV."""
    found = lambda pattern, mark: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(mark), F.upper(x)))
    return F.array_distinct(F.concat(found(FIGURE, "F"), found(TABLE, "T")))


def norm_text(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[“”\"'`]+", ""), "[ \t\n\r]+", " ")


def normalize_inline(text: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(text, "\r", ""), "[ \t ]+", " ")
    x = F.regexp_replace(x, " +([),.;:}]|\\])", "$1")
    x = F.regexp_replace(x, "([(\\[{]) +", "$1")
    x = F.regexp_replace(x, "([a-z])(Figure|Table)", "$1 $2")
    return F.trim(F.regexp_replace(x, "([0-9]%)of", "$1 of"))


def head_hint(head: Column) -> Column:
    x = F.lower(F.regexp_replace(F.regexp_replace(F.trim(head), r"^([0-9.]+|[IVX]+\.) *", ""), "&", "and"))
    return (
        F.when(x.rlike("^(introduction|background)"), "INTRO")
        .when(x.rlike("^(materials and methods|methods?|methodology|experimental|patients and methods|study design)"), "METHODS")
        .when(x.rlike("^(results and discussion|discussion|conclusions?|limitations)"), "DISCUSSION")
        .when(x.rlike("^results"), "RESULTS")
        .when(x.rlike("^(references|bibliography)"), "REFERENCES")
        .otherwise("OTHER")
    )


def normalize_type(t: Column) -> Column:
    """Any spelling of a type as one of the eight, else Other: signs around it do not count, the first word that fits does."""
    exact = F.trim(t)
    low = F.regexp_replace(F.lower(exact), "^[ :._-]+|[ :._-]+$", "")
    has = lambda *words: reduce(Column.__or__, [low.contains(w) for w in words])
    return (
        F.when(exact.isin(*dims.TYPES), exact).when(has("hypo"), "Hypothesis").when(has("experi"), "Experiment")
        .when(has("techni", "method"), "Technique").when(has("result", "observ", "finding", "eviden"), "Result")
        .when(has("dataset", "data set", "corpus", "benchmark", "cohort") | (low == "data"), "Dataset")
        .when(has("conclu"), "Conclusion").when(has("analys"), "Analysis").when(has("fact", "assump"), "Input Fact")
        .otherwise(dims.lookup(dims.SYNONYMS, F.lower(exact), default="Other"))
    )


def imrad_norm(section: Column) -> Column:
    """The standard section that a section name stands for."""
    return dims.lookup(dims.IMRAD, F.upper(F.coalesce(section, F.lit(""))), default="OTHER")


def canon_type(t: Column) -> Column:
    """A type whatever its case and spaces; null for what is none."""
    return dims.lookup({x.lower().replace(" ", ""): x for x in dims.TYPES}, F.replace(F.lower(t), F.lit(" "), F.lit("")), default=None)


def soft_cut(text: Column, most: int = 220, slack: int = 40) -> Column:
    """At most `most` characters, longer by up to `slack` to end with a sentence, with an ellipsis if cut."""
    stop = F.locate(".", F.substring(text, most + 1, slack))
    return F.when(F.length(text) <= most, text).when(stop > 0, F.concat(F.left(text, F.lit(most) + stop), F.lit("…"))).otherwise(F.concat(F.left(text, F.lit(most)), F.lit("…")))


def polarity(text: Column) -> Column:
    """Outcome of a sentence by lemma. A negated word counts for neither side; a negated harm voids all harms; a phrase of
    a missing effect is a harm; both sides or none are neutral. Negations reach the next word.

    Words after a negation are counted apart from all, so that no lookup runs word by word.
    """
    low = F.lower(text)
    phrase = reduce(Column.__or__, [low.contains(p) for p in dims.NEGATIVE_PHRASES])
    negation, word = r"(?:(?<![a-z0-9])(?:not|never)|n['’]t)[^a-z0-9]+", "(?<![a-z0-9])"

    def count(lemmas: list[str], before: str) -> Column:
        forms = "|".join(form for w in lemmas for form in inflections(w))
        return F.regexp_count(low, F.lit(f"{before}(?:{forms})(?![a-z0-9])"))

    plain = lambda lemmas: count(lemmas, word) > count(lemmas, negation)
    void = (count(dims.NEUTRALISED, negation) > 0) | (count(dims.NEUTRALISED, word + "no[^a-z0-9]+") > 0)
    good, harm = plain(dims.POSITIVE), phrase | (~void & plain(dims.NEGATIVE))
    return F.when(good & ~harm, "positive").when(harm & ~good, "negative").otherwise("neutral")


def inflections(lemma: str) -> list[str]:
    stem = lemma[:-1] if lemma.endswith("e") else lemma
    return [lemma, lemma + "s", stem + "ed", stem + "ing"]


def join_lines(text: Column) -> Column:
    """Extracted text on one line: hyphenated words and split numbers joined, single line ends as spaces; blank lines stay."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    x = F.regexp_replace(x, "([\\p{L}\\p{N}_])[-\u00ad]\n([\\p{L}\\p{N}_])", "$1$2")
    x = F.regexp_replace(x, "([0-9])[ \t]*\n\\s*([0-9])", "$1.$2")
    x = F.regexp_replace(x, "\\)\\s*\n\\s*([0-9])", ") $1")
    x = F.regexp_replace(x, "(?<!\n)\n(?!\n)", " ")
    return F.trim(F.regexp_replace(x, "[ \t]{2,}", " "))


def boxes(coords: Column) -> Column:
    """Boxes (page, x, y, w, h) of a coordinate list such as 1,10,20,30,40;2,..., with or without p or page before the page; others are left out."""
    one = r"^\s*(?:p(?:age)?)?[ :]*([0-9]+)[ :,]+(-?[0-9.]+),(-?[0-9.]+),(-?[0-9.]+),(-?[0-9.]+)\s*$"
    part = lambda x, i: F.regexp_extract(x, one, i)
    fits = F.filter(F.split(F.coalesce(coords, F.lit("")), ";"), lambda x: x.rlike(one))
    return F.transform(fits, lambda x: F.struct(part(x, 1).cast("int").alias("page"), *[part(x, i).cast("double").alias(n) for i, n in enumerate("xywh", 2)]))


def union_box(found: Column) -> Column:
    """(page, x0, y0, x1, y1) around the boxes on the first box's page; a null page and zeros without boxes."""
    same = F.filter(found, lambda b: b["page"] == F.get(found, 0)["page"])
    low = lambda f: F.coalesce(F.array_min(F.transform(same, f)), F.lit(0.0))
    high = lambda f: F.coalesce(F.array_max(F.transform(same, f)), F.lit(0.0))
    return F.struct(
        F.get(found, 0)["page"].alias("page"), low(lambda b: b["x"]).alias("x0"), low(lambda b: b["y"]).alias("y0"),
        high(lambda b: b["x"] + b["w"]).alias("x1"), high(lambda b: b["y"] + b["h"]).alias("y1"),
    )


def slug(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit("")), F.lit("x"))


def stable_id(path: Column) -> Column:
    """The file's name without its ending, and eight digits of its whole path's digest."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), F.lit("-"), F.substring(F.md5(path), 1, 8))


def cache_key(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def theme_list(given: Column) -> Column:
    """Themes of a list split by commas or semicolons, without auto, each once, common first."""
    parts = F.transform(F.split(F.coalesce(given, F.lit("")), "[,;]"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.concat(F.array(F.lit("common")), F.filter(parts, lambda x: (x != "") & (x != "auto"))))


def file_name(text: Column, most: int = 180) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"[\\\\/:*?\"<>|\s]+", " ")), F.lit(most))


def listed_items(text: Column) -> Column:
    """Whether numbers in a text number a list rather than cite: no group of numbers in one bracket, no two cited authors."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    group = text.rlike(r"\(\s*[0-9]+(\s*[,;–-]\s*[0-9]+)+\s*\)")
    authors = count(r"\b\p{Lu}[\p{L}’'-]+(\s+et\s+al\.?)?\s*\(\s*[0-9]+\s*\)") >= 2
    marks = count(r"\(\s*[0-9]+\s*\)") + count(r"(?i)(^|[\s;])([0-9]+|[ivxlcdm]+)\s*[).*]\s")
    aims = text.rlike(r"(?i)\b(aims?|objectives?|goals?|purpose|hypothes[ie]s)\b")
    colon = text.rlike(r"(?i):\s*(\(\s*1\s*\)|([0-9]+|[ivxlcdm]+)\s*[).*]\s)")
    return ~group & ~authors & (((marks > 0) & aims) | colon | (marks >= 2))
