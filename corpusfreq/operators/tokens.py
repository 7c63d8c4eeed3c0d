"""Token tables and per-document token arrays.

The array form keeps a document in one row and needs no shuffle; the table form
has one row per token: ``doc_id, ord, norm, line, start, end``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusfreq.functions.text import TOKEN_PATTERN, line_tokens, may_contain, norms, spans
from corpusfreq.plans.ranking import ordinal_within

StopWords = Sequence[str] | DataFrame | None


def _as_list(stop: StopWords) -> Sequence[str] | None:
    return None if stop is None or isinstance(stop, DataFrame) else list(stop)


def explode_tokens(docs: DataFrame, tokens: str = "tokens", keep: Sequence[str] = ("doc_id",)):
    """One row per element of a token array, numbered by ``ord`` from 0.

    The outer form keeps the optimizer from adding a test for empty arrays, which
    would tokenise every text once more, before any exchange.
    """
    rows = docs.select(*keep, F.posexplode_outer(tokens).alias("ord", "__t"))
    return rows.where(F.col("ord").isNotNull()).select(*keep, "ord", "__t.*")


def tokenize_spans(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    pattern: str = TOKEN_PATTERN,
    lower: bool = False,
) -> DataFrame:
    """Every match with its character offsets in the text."""
    return explode_tokens(
        docs.select(doc, spans(F.col(text), pattern, lower).alias("tokens")), keep=(doc,)
    )


def tokenize(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    pattern: str = TOKEN_PATTERN,
    lower: bool = False,
    stop: StopWords = None,
    offset: int = 0,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Every match with its line and its offsets inside the line.

    A stop list given as Python strings is applied inside the row; one given as a
    table is an anti join, which the planner broadcasts if its bytes allow it.
    """
    words = _as_list(stop)
    tokens = line_tokens(F.col(text), pattern, lower, offset, words)
    rows = explode_tokens(
        docs.select(doc, *keep, tokens.alias("tokens")), keep=(doc, *keep)
    )
    return remove_stop_words(rows, stop) if isinstance(stop, DataFrame) else rows


def tokenizer(docs: DataFrame, stop: StopWords = None, **options) -> DataFrame:
    """Tokenise and lower-case, optionally without stop words."""
    return tokenize(docs, lower=True, stop=stop, **options)


def normalize(tokens: DataFrame, norm: str = "norm") -> DataFrame:
    return tokens.withColumn(norm, F.lower(norm))


def remove_stop_words(tokens: DataFrame, stop: StopWords, norm: str = "norm") -> DataFrame:
    """Positions of the surviving tokens do not change."""
    if isinstance(stop, DataFrame):
        words = stop.select(F.col(stop.columns[0]).alias("__stop"))
        return tokens.join(words, F.col(norm) == F.col("__stop"), "left_anti")
    return tokens.where(~F.col(norm).isin(*stop)) if stop else tokens


def token_index(
    tokens: DataFrame,
    doc: str = "doc_id",
    order_by: Sequence[str] = ("line", "start"),
    out: str = "ord",
    long_groups: bool = False,
) -> DataFrame:
    """Number the tokens of each document from 0 in text order.

    The default sorts per document, which is bounded when a document came from
    one text. ``long_groups=True`` is for sequences gathered from many rows, where
    one key may hold much of the table; it never gathers a group in one task.
    """
    if long_groups:
        return ordinal_within(tokens.drop(out), doc, order_by, out)
    window = Window.partitionBy(doc).orderBy(*order_by)
    return tokens.withColumn(out, F.row_number().over(window) - 1)


def tokenize_documents(
    docs: DataFrame,
    text: str = "text",
    pattern: str = TOKEN_PATTERN,
    lower: bool = True,
    stop: Sequence[str] | None = None,
) -> DataFrame:
    """Add the token array and the array of distinct token types."""
    with_tokens = docs.withColumn(
        "tokens", line_tokens(F.col(text), pattern, lower, 0, _as_list(stop))
    )
    return with_tokens.withColumn(
        "types", F.array_distinct(F.transform("tokens", lambda t: t["norm"]))
    )


def corpus_vectors(
    docs: DataFrame,
    target: str | None = None,
    doc: str = "doc_id",
    text: str = "text",
    stop: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per document with its token vector; the array index is the ordinal.

    With a target, only documents that contain it.
    """
    if target is not None:
        docs = docs.where(may_contain(F.col(text), target))
    vector = norms(F.col(text), stop=_as_list(stop))
    vectors = docs.select(doc, *keep, vector.alias("vector"))
    return vectors if target is None else vectors.where(F.array_contains("vector", target))
