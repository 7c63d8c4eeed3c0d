"""Keyword-in-context concordances.

Each line of a text that holds a token is cut into alternating pieces, gap and
token; a context is a slice of the pieces. Everything happens inside the
document's row: no shuffle, and no search through the text per hit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusfreq.functions.arrays import let, running_sums
from corpusfreq.functions.text import (
    TOKEN_PATTERN,
    lines,
    matches,
    may_contain,
    norm_ws,
    norms,
)
from corpusfreq.operators.context import reach_back
from corpusfreq.sources.corpus import base_name

# Column widths of a formatted concordance line.
NAME_WIDTH, LINE_WIDTH, START_WIDTH = 25, 7, 3


def _line_parts(text: Column, pattern: str, lower: bool, stop: Sequence[str] | None) -> Column:
    """Per line: its pieces and its tokens, each knowing its place among the pieces."""

    def one(line: Column, number: Column) -> Column:
        def build(found: Column) -> Column:
            gaps = F.split(line, pattern, -1)

            def assemble(g: Column) -> Column:
                inner = F.slice(g, 1, F.size(found))
                steps = F.zip_with(inner, found, lambda a, b: F.length(a) + F.length(b))
                pairs = F.flatten(F.zip_with(inner, found, lambda a, b: F.array(a, b)))
                tail = F.concat(F.element_at(g, -1), F.lit("\n"))
                tokens = F.transform(
                    F.arrays_zip(found.alias("word"), running_sums(steps).alias("end")),
                    lambda t, i: F.struct(
                        (F.lower(t["word"]) if lower else t["word"]).alias("norm"),
                        number.alias("line"),
                        (t["end"] - F.length(t["word"])).alias("start"),
                        t["end"].alias("end"),
                        (2 * i + 1).alias("at"),
                    ),
                )
                if stop:
                    tokens = F.filter(tokens, lambda t: ~t["norm"].isin(*stop))
                return F.struct(
                    F.concat(pairs, F.array(tail)).alias("pieces"), tokens.alias("tokens")
                )

            return let(gaps, assemble)

        return let(matches(line, pattern), build)

    return F.filter(F.transform(lines(text), one), lambda p: F.size(p["tokens"]) > 0)


def _document_parts(parts: Column) -> Column:
    """Join the lines of a document: all pieces, and tokens placed among them."""

    def place(ends: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            stop = F.get(ends, i)
            begin = stop - F.size(part["pieces"])
            return F.transform(
                part["tokens"],
                lambda t: F.struct(
                    t["norm"].alias("norm"),
                    t["line"].alias("line"),
                    t["start"].alias("start"),
                    t["end"].alias("end"),
                    (begin + t["at"]).alias("at"),
                    begin.alias("line_at"),
                    stop.alias("line_stop"),
                ),
            )

        return F.struct(
            F.flatten(F.transform(parts, lambda p: p["pieces"])).alias("pieces"),
            F.flatten(F.transform(parts, one)).alias("tokens"),
        )

    return let(running_sums(F.transform(parts, lambda p: F.size(p["pieces"]))), place)


def _concordance(pieces: Column, tokens: Column, target: str, size: int, compat: bool) -> Column:
    """The concordance lines of one document."""
    # Every token measures at least 2, so no context holds more tokens than this.
    most = size // 2 + 2
    text = lambda a, b: norm_ws(F.array_join(F.slice(pieces, a + 1, b - a), ""))

    def build(sums: Column) -> Column:
        def hit(h: Column) -> Column:
            t = F.get(tokens, h)
            back = reach_back(sums, h - 1, size, most)
            if compat:
                at_start = text(t["at"], t["line_stop"])
            else:
                at_start = text(t["line_at"], t["at"])
            prefix = F.when(h == 0, at_start).otherwise(
                text(F.get(tokens, h - back)["at"], t["at"])
            )
            room = F.least(F.lit(most), F.size(tokens) - 1 - h)
            ahead = F.size(
                F.filter(
                    F.slice(sums, h + 1, room),
                    lambda c: 1 + c - F.get(sums, h) <= F.lit(size),
                )
            )
            suffix = F.when(ahead == 0, text(t["at"] + 1, t["line_stop"])).otherwise(
                text(t["at"] + 1, F.get(tokens, h + ahead)["at"] + 1)
            )
            return F.struct(
                t["line"].alias("line"),
                t["start"].alias("start"),
                t["end"].alias("end"),
                prefix.alias("prefix"),
                F.get(pieces, t["at"]).alias("target"),
                suffix.alias("suffix"),
            )

        hits = F.filter(
            F.sequence(F.lit(0), F.size(tokens) - 1),
            lambda i: F.get(tokens, i)["norm"] == F.lit(target),
        )
        return F.transform(hits, hit)

    return let(running_sums(F.transform(tokens, lambda t: 1 + t["end"] - t["start"])), build)


def kwic(
    docs: DataFrame,
    target: str,
    size: int,
    doc: str = "doc_id",
    text: str = "text",
    pattern: str = TOKEN_PATTERN,
    lower: bool = True,
    stop: Sequence[str] | None = None,
    index: DataFrame | None = None,
    compat: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per occurrence: ``line, start, end, prefix, target, suffix``.

    Contexts cross lines, keep punctuation and have their white space normalised.
    They hold tokens until their measure (length plus one each) exceeds ``size``.
    With an inverted index only the documents it lists for the target are read.

    The prefix of a document's first token is what precedes it in its line;
    ``compat`` gives the rest of that line instead.
    """
    if index is not None:
        listed = index.where(F.col("norm") == target).select(F.col(doc).alias("__doc"))
        docs = docs.join(listed, F.col(doc) == F.col("__doc"), "left_semi")
    words = norms(F.col(text), pattern, lower, stop)
    holds = may_contain(F.col(text), target, lower) & F.array_contains(words, target)
    cut = let(_line_parts(F.col(text), pattern, lower, stop), _document_parts)
    parts = docs.select(doc, *keep, F.when(holds, cut).alias("__p"))
    found = let(
        F.col("__p"), lambda p: _concordance(p["pieces"], p["tokens"], target, size, compat)
    )
    return parts.select(doc, *keep, F.inline(F.when(F.col("__p").isNotNull(), found)))


def sync_lines(
    text_lines: DataFrame, hits: DataFrame, doc: str = "doc_id", line: str = "line"
) -> DataFrame:
    """Attach to every numbered line its hits, sorted; an empty list if it has none."""
    place = F.struct(line, "start", "end")
    grouped = hits.groupBy(F.col(doc).alias("__doc"), F.col(line).alias("__line")).agg(
        F.array_sort(F.collect_list(place)).alias("hits")
    )
    joined = text_lines.join(
        grouped, (F.col(doc) == F.col("__doc")) & (F.col(line) == F.col("__line")), "left"
    )
    none = F.array().cast("array<struct<line:int,start:int,end:int>>")
    return joined.select(*text_lines.columns, F.coalesce("hits", none).alias("hits"))


def _pad_left(value: Column, width: int) -> Column:
    text = value.cast("string")
    # lpad would cut longer text.
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(" "))


def format_kwic(rows: DataFrame, size: int, doc: str = "doc_id", out: str = "text") -> DataFrame:
    """Concordance rows as aligned text lines."""
    name = base_name(F.col(doc).cast("string"))
    prefix = F.when(F.length("prefix") > size, F.right("prefix", F.lit(size))).otherwise(
        F.col("prefix")
    )
    line = F.concat(
        _pad_left(name, NAME_WIDTH),
        F.lit(":"),
        _pad_left(F.col("line"), LINE_WIDTH),
        F.lit(":"),
        _pad_left(F.col("start"), START_WIDTH),
        F.lit("  "),
        _pad_left(prefix, size),
        F.lit("  **"),
        F.col("target"),
        F.lit("**  "),
        F.left("suffix", F.lit(size)),
    )
    return rows.select(doc, "line", "start", line.alias(out))
