"""Tokenisation and text slicing as column expressions.

Everything here works on one row at a time, so tokenising a corpus needs neither
a shuffle nor a Python worker, and runs unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusfreq.functions.arrays import let, running_sums

# Fixed value: the default token pattern (runs of letters and combining marks).
TOKEN_PATTERN = r"[\p{L}\p{M}]+"

# Fixed value: what counts as white space when contexts are normalised.
SPACE_PATTERN = r"[\t-\r\p{Zs}]+"


def matches(text: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """All matches of ``pattern`` as an array of strings."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def norms(
    text: Column,
    pattern: str = TOKEN_PATTERN,
    lower: bool = True,
    stop: Sequence[str] | None = None,
) -> Column:
    """Token texts only, in order; the cheap form when positions are not needed."""
    found = matches(text, pattern)
    if lower:
        found = F.transform(found, F.lower)
    if stop:
        found = F.filter(found, lambda t: ~t.isin(*stop))
    return found


def may_contain(text: Column, target: str, lower: bool = True) -> Column:
    """A cheap test that is true for every text holding the token.

    Lower-casing a whole text and a single token agree on ASCII letters; for other
    targets the test lets everything pass.
    """
    if not target.isascii():
        return F.lit(True)
    return (F.lower(text) if lower else text).contains(target)


def spans(text: Column, pattern: str = TOKEN_PATTERN, lower: bool = False) -> Column:
    """Tokens with character offsets: ``array<struct<norm,start,end>>``, end exclusive.

    The pattern must not match the empty string. The offsets are running sums
    over the lengths of the tokens and of the gaps between them.
    """

    def build(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda g, t: F.length(g) + F.length(t))
        norm = (lambda t: F.lower(t)) if lower else (lambda t: t)
        return F.zip_with(
            found,
            running_sums(steps),
            lambda t, end: F.struct(
                norm(t).alias("norm"), (end - F.length(t)).alias("start"), end.alias("end")
            ),
        )

    return let(matches(text, pattern), build)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_tokens(
    text: Column,
    pattern: str = TOKEN_PATTERN,
    lower: bool = False,
    offset: Column | int = 0,
    stop: Sequence[str] | None = None,
) -> Column:
    """Tokens of every line: ``array<struct<norm,line,start,end>>`` in text order.

    Lines are numbered from ``offset``; start and end count inside the line.
    """
    base = F.lit(offset) if isinstance(offset, int) else offset

    def one_line(line: Column, number: Column) -> Column:
        return F.transform(
            spans(line, pattern, lower),
            lambda t: F.struct(
                t["norm"].alias("norm"),
                (base + number).cast("int").alias("line"),
                t["start"].alias("start"),
                t["end"].alias("end"),
            ),
        )

    tokens = F.flatten(F.transform(lines(text), one_line))
    if stop:
        tokens = F.filter(tokens, lambda t: ~t["norm"].isin(*stop))
    return tokens


def norm_ws(text: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, SPACE_PATTERN, " "))


def slice_lines(text: Column, run: Column) -> Column:
    """Source text covered by a token run, one string per line that holds a token.

    ``run`` is ``array<struct<line,start,end>>`` in text order. The first line is
    cut at the first token's start, the last one at the last token's end, inner
    lines are whole. A run of one token reaches to the end of its line.
    """

    def build(r: Column) -> Column:
        first, last = F.element_at(r, 1), F.element_at(r, -1)
        numbers = F.array_distinct(F.transform(r, lambda t: t["line"]))

        def cut(number: Column, source: Column) -> Column:
            line = F.element_at(source, number + 1)
            begin = F.when(number == first["line"], first["start"]).otherwise(0)
            end = F.when(
                (number == last["line"]) & (F.size(r) > 1), last["end"]
            ).otherwise(F.length(line))
            return F.substring(line, begin + 1, end - begin)

        return let(lines(text), lambda source: F.transform(numbers, lambda n: cut(n, source)))

    empty = F.array().cast("array<string>")
    return F.when(F.size(run) == 0, empty).otherwise(let(run, build))
