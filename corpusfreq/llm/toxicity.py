"""Toxicity by a weighted lexicon.

Texts are folded first: lower case, base letters of full-width and other compatibility
forms and of rare accents, look-alike letters of other scripts, digits and signs that stand
for letters; letters that share a look (i, l, 1) become one. Lexicon entries are folded
the same way and found by one Aho-Corasick automaton, as whole words or, if learnt as
stems, as beginnings of words. A match inside
an exception phrase does not count. The weights found are summed, normalised by the
text's length, and turned into a probability by a logistic curve.

``fit`` learns entries, exceptions and curve from at most ``MAX_LABELS`` labelled rows
(those of smallest id hash), which bounds all that is broadcast or held on the driver at any
corpus size: a form must stand in ``SUPPORT`` of the toxic examples, so there are at most
1 / ``SUPPORT`` times as many as an average example holds, and an exception needs
``EXCEPTION_DOCS`` clean examples. None of those is left out. Rows of one label whose texts
have the same set of folded words are one example, in every count.

Defined cases: a null or empty text matches nothing and has the score of a text without a
match; null labels or ids teach nothing; without toxic examples the lexicon is empty and
every score is the same; repeated rows are scored alike; texts are read whole; other columns
are not read, and columns that are kept may have any names but those of the answers.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.store import stored
from corpusfreq.llm.workers import package_path

MAX_LABELS = 200_000
# An entry needs this share of the toxic examples, this many, and this log-ratio.
SUPPORT = 0.03
MIN_DOCS = 3
MIN_WEIGHT = 1.5
# Lengths of stems; how often one text can count.
STEM = (4, 9)
REPEATS = 3
EXCEPTION_DOCS = 3
LEVEL = 0.3

# Letters of other scripts, digits and signs that look like Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "ɑ": "a", "ɡ": "g", "đ": "d", "ł": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i",
}
# Letters of their own in western European languages: they keep their accents.
KEPT = frozenset("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ")
# One shape for letters written alike.
SAME_SHAPE = {"l": "i", "j": "i"}
WORD = re.compile(r"\w+")


@lru_cache(1)
def fold_table() -> dict[int, str]:
    """Character to folded form, for every character whose folded form differs."""
    table: dict[int, str] = {}
    for code in range(sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or unicodedata.category(char) in ("Cn", "Co"):
            continue
        if unicodedata.category(char) in ("Mn", "Cf"):
            table[code] = ""
            continue
        if char.lower() in KEPT:
            base = char.lower()
        else:
            base = unicodedata.normalize("NFKD", char).lower()
        base = "".join(LOOK_ALIKES.get(c, c) for c in base if unicodedata.category(c) not in ("Mn", "Cf"))
        base = "".join(SAME_SHAPE.get(c, c) for c in base)
        if base != char:
            table[code] = base
    return table


def fold(text: str) -> str:
    return text.translate(fold_table())


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (0.0, 0.0, -20.0)


class Matcher:
    """Finds a lexicon's entries in folded texts."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for form, weight in lexicon.weights.items():
            stem = form.rstrip("*")
            self.automaton.add_word(stem, (len(stem), stem != form, weight))
        if lexicon.weights:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> Iterator[tuple[int, int, float]]:
        """(start, stop, weight) of entries that stand as whole words, or begin one."""
        if not self.lexicon.weights:
            return
        n = len(folded)
        for end, (length, stem, weight) in self.automaton.iter(folded):
            start, stop = end + 1 - length, end + 1
            if start and folded[start - 1].isalnum():
                continue
            if stem:
                while stop < n and folded[stop].isalnum():
                    stop += 1
            elif stop < n and folded[stop].isalnum():
                continue
            yield start, stop, weight

    def phrases(self, folded: str, start: int, stop: int) -> list[str]:
        """The match with the word before it and with the word behind it."""
        word = folded[start:stop]
        before = re.search(r"(\w+)\W{1,3}$", folded[max(0, start - 40) : start])
        behind = re.match(r"\W{1,3}(\w+)", folded[stop : stop + 40])
        return [f"{before[1]} {word}" if before else "", f"{word} {behind[1]}" if behind else ""]

    def features(self, text: str) -> tuple[float, float, int]:
        """(log of summed weight, weight per length, matches) without exceptions."""
        folded = fold(text)
        total, found = 0.0, 0
        for start, stop, weight in self.matches(folded):
            if self.lexicon.exceptions and not self.lexicon.exceptions.isdisjoint(self.phrases(folded, start, stop)):
                continue
            total += weight
            found += 1
        # Length in words, about; short texts count as a few words.
        length = folded.count(" ") + folded.count("\n") + 20
        return float(np.log1p(total)), total / length, found

    def score(self, text: str) -> tuple[float, int]:
        a, b, found = self.features(text)
        x, y, z = self.lexicon.curve
        return float(1.0 / (1.0 + np.exp(-(x * a + y * b + z)))), found


def _learning_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(body, bad) of at most ``MAX_LABELS`` labelled documents."""
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("bad")).where("k IS NOT NULL AND bad IS NOT NULL")
    known = known.groupBy("k").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(MAX_LABELS)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("body"))
    return texts.join(F.broadcast(known), F.col("i") == F.col("k")).select("body", "bad")


def _examples(rows: DataFrame) -> DataFrame:
    """(body, bad): one row of all that have the same label and the same set of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(WORD.findall(fold(t or "")))) for t in batch.column(0).to_pylist()]
            keys = [hashlib.blake2b(" ".join(w).encode(), digest_size=16).digest() for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *batch.columns], names=["same", "body", "bad"])

    named = rows.mapInArrow(run, "same binary, body string, bad int")
    return named.groupBy("same", "bad").agg(F.min("body").alias("body")).select("body", "bad")


def _count(rows: DataFrame, tokens, columns: str) -> DataFrame:
    """(item, bad, n): in how many rows ``tokens(text)`` has the item, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.update((t, bad) for t in tokens(text or ""))
            if len(counts) > 1_000_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return rows.mapInArrow(run, columns).groupBy("item", "bad").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([counts[k] for k in keys], pa.int64()),
        ],
        names=["item", "bad", "n"],
    )


COUNTS = "item string, bad int, n bigint"


def _forms(word: str) -> list[str]:
    """What may become an entry: the word, and its stems marked with a star."""
    return [word, *(word[:k] + "*" for k in range(STEM[0], min(len(word), STEM[1]) + 1))]


def _entries(rows: DataFrame, toxic: int, clean: int) -> dict[str, float]:
    """Words and stems much more frequent in toxic texts, with log-ratio weights."""

    def all_forms(text: str) -> list[str]:
        found = Counter(f for w in WORD.findall(fold(text)) for f in _forms(w))
        return [f for f, n in found.items() for _ in range(min(n, REPEATS))]

    least = max(MIN_DOCS, SUPPORT * toxic)
    often = _count(rows.where("bad = 1"), all_forms, COUNTS).where(F.col("n") >= least)
    bad = {r["item"]: r["n"] for r in often.collect()}
    names = set(bad)

    def known_forms(text: str) -> list[str]:
        found = Counter(f for w in WORD.findall(fold(text)) for f in _forms(w) if f in names)
        return [f for f, n in found.items() for _ in range(min(n, REPEATS))]

    good = {r["item"]: r["n"] for r in _count(rows.where("bad = 0"), known_forms, COUNTS).collect()}
    weights, gain = {}, {}
    for form, n in bad.items():
        m = good.get(form, 0)
        weight = float(np.log((n + 0.5) / (toxic + 1)) - np.log((m + 0.5) / (clean + 1)))
        if weight >= MIN_WEIGHT:
            expected = (n + m) * toxic / (toxic + clean)
            weights[form] = weight
            gain[form] = n * np.log(n / expected) + (m * np.log(m / (n + m - expected)) if m else 0.0)
    names = set(weights)

    def chosen_forms(text: str) -> set[str]:
        return {f for w in WORD.findall(fold(text)) for f in _forms(w) if f in names}

    # Above a form counts up to REPEATS times in an example, here once.
    held = _count(rows.where("bad = 1"), chosen_forms, COUNTS).where(F.col("n") >= least)
    names = {r["item"] for r in held.collect()}
    # Of forms that begin alike the best stays.
    chosen: dict[str, float] = {}
    stems: set[str] = set()
    beginnings: set[str] = set()
    for form in sorted(names, key=lambda f: (-gain[f], -len(f), f)):
        stem = form.rstrip("*")
        parts = [stem[:k] for k in range(1, len(stem) + 1)]
        if stem not in beginnings and stems.isdisjoint(parts):
            chosen[form] = weights[form]
            stems.add(stem)
            beginnings.update(parts)
    return chosen


def _exceptions(rows: DataFrame, weights: dict[str, float], toxic: int, clean: int) -> set[str]:
    """Phrases around an entry that are no more frequent in toxic texts than in clean ones."""
    matcher = Matcher(Lexicon(weights=weights))

    def phrases(text: str) -> set[str]:
        folded = fold(text)
        return {p for a, b, _ in matcher.matches(folded) for p in matcher.phrases(folded, a, b) if p}

    counts = _count(rows, phrases, COUNTS).groupBy("item").pivot("bad", [0, 1]).agg(F.sum("n")).na.fill(0)
    no_sign = F.col("1") * F.lit(clean) <= F.col("0") * F.lit(toxic)
    safe = counts.where((F.col("0") >= EXCEPTION_DOCS) & no_sign)
    return {r["item"] for r in safe.select("item").collect()}


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float, float]:
    """Logistic curve over the two features, from counts of rounded feature values."""
    matcher = Matcher(lexicon)

    def cell(text: str) -> list[str]:
        a, b, _ = matcher.features(text)
        return [f"{round(a * 4)} {round(min(b, 4.0) * 40)}"]

    cells = _count(rows, cell, COUNTS).collect()  # a grid: bounded by the rounding
    if not cells:
        return lexicon.curve
    x = np.array([[int(p) for p in r["item"].split()] for r in cells], float) / [4, 40]
    x = np.hstack([x, np.ones((len(x), 1))])
    y, n = np.array([r["bad"] for r in cells], float), np.array([r["n"] for r in cells], float)
    w = np.zeros(3)
    ridge = np.diag([0.05, 0.05, 1e-3])
    for _ in range(100):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Lexicon:
    """Learn a lexicon from the documents that ``labels`` (id, label) covers."""
    package_path(docs.sparkSession)
    rows = stored(_examples(_learning_rows(docs, labels, id_col, text_col, label_col)), "examples")
    totals = {r["bad"]: r["n"] for r in rows.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    lexicon = Lexicon()
    if toxic:
        lexicon.weights = _entries(rows, toxic, clean)
    if lexicon.weights:
        lexicon.exceptions = _exceptions(rows, lexicon.weights, toxic, clean)
    lexicon.curve = _curve(rows, lexicon)
    return lexicon


def score(
    docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), level: float = LEVEL
) -> DataFrame:
    """The columns ``keep``, then score, predicted (score >= ``level``) and number of matches."""
    package_path(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer").add("n_matches", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [matcher.score(t.as_py() or "") for t in texts]
            scores = [s for s, _ in found]
            columns = [
                *batch.columns[:-1], pa.array(scores, pa.float64()),
                pa.array([int(s >= level) for s in scores], pa.int32()), pa.array([k for _, k in found], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.select(*keep, F.col(text_col)).mapInArrow(run, schema)
