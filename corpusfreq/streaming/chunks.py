"""Documents that arrive in pieces.

A row of the stream is a chunk of a document: ``doc_id, chunk, text, last``. Chunks are
numbered from 0 and may be cut anywhere, inside a line or a word; they arrive in any order,
in any number of micro-batches. The row with ``last`` ends its document.

The state of a document is what the next chunk continues: the line and column reached, the
unfinished token at the end, the last n - 1 tokens, and chunks that came before their turn.
Its size does not grow with the document. The state function only cuts the text where no
token is open and hands it on; tokens are found before and after it by the same column
expressions as in batch, so results equal those of the joined text.

A call of the state function costs far more than a chunk does. So documents are dealt to
buckets by a hash of their id, a call takes the chunks that have arrived for a bucket, and a
row of the state holds the open documents of a bucket; a bucket without any leaves no row.
More buckets make smaller calls. Their number belongs to the stream: it must not change
between restarts.

The token pattern must match runs of one class of characters, as the default does: then a
run that a cut divides is one token again.

Defined cases: a chunk whose number has been taken is ignored, so a source may send it
again; a null text is empty; a null ``last`` is false; a document without an end keeps its
unfinished token in the state; after its end an id may be used anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.functions.arrays import let
from corpusfreq.functions.text import TOKEN_PATTERN, line_tokens, matches
from corpusfreq.operators.ngrams import ngrams
from corpusfreq.operators.tokens import StopWords, _as_list, explode_tokens, remove_stop_words

# The open documents of a bucket as JSON: [id, next chunk, next piece, line, column, tokens so
# far, open token, tokens before, chunks that wait].
STATE = "documents string"
START = (0, 0, 0, 0, 0, "", [], "[]")
BUCKETS = 4096
# Pieces in a frame that the state function hands on.
FRAME_PIECES = 2000


def stepper(n: int) -> Callable[[list, dict], tuple | None]:
    """What takes the next chunk into a document's state.

    Made here and not defined by the module, so that it travels to the workers by value:
    they need not have this package.
    """

    def step(state: list, chunk: dict) -> tuple | None:
        """The text that no longer changes, with its place; none while a token is open."""
        _, piece, line, col, seen, open_, before, _ = state
        text, last, tail = chunk["text"], chunk["last"], list(chunk["tail"])
        state[0] += 1
        # Nothing, or one run of token characters: the open token may still go on.
        one_run = chunk["count"] == 1 and chunk["begins"] and chunk["ends"]
        if (one_run or not text) and not last:
            state[5] = open_ + text
            return None
        whole, count = open_ + text, chunk["count"]
        if open_ and chunk["begins"]:
            if count <= len(tail):
                tail[0] = open_ + tail[0]
        elif open_:
            tail, count = [open_, *tail], count + 1
        rest = ""
        if chunk["ends"] and not last:
            rest, count = tail.pop(), count - 1
            whole = whole[: len(whole) - len(rest)]
        state[5] = rest
        if not whole:
            return None
        state[1], state[4] = piece + 1, seen + count
        breaks = whole.count("\n")
        state[2] = line + breaks
        state[3] = len(whole) - whole.rfind("\n") - 1 if breaks else col + len(whole)
        state[6] = [*before, *tail][-(n - 1) :] if n > 1 else []
        return piece, line, col, seen, whole, list(before)

    return step


def pieces(
    chunks: DataFrame,
    n: int = 1,
    doc: str = "doc_id",
    chunk: str = "chunk",
    text: str = "text",
    last: str = "last",
    pattern: str = TOKEN_PATTERN,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id, piece, line, col, ord, text, before``: the text again, cut between tokens.

    ``line`` and ``col`` say where the piece begins, ``ord`` numbers its first token, and
    ``before`` holds the n - 1 tokens ahead of it.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    body = F.coalesce(F.col(text), F.lit(""))

    def facts(found):
        first, end = F.get(found, F.lit(0)), F.get(found, F.size(found) - 1)
        return F.struct(
            F.size(found).alias("count"),
            F.slice(found, F.greatest(F.size(found) - F.lit(n - 1), F.lit(1)), n).alias("tail"),
            F.coalesce(body.startswith(first), F.lit(False)).alias("begins"),
            F.coalesce(body.endswith(end), F.lit(False)).alias("ends"),
        )

    kind = chunks.schema[doc].dataType.simpleString()
    # Ids travel as text; the empty one is null.
    named = F.hex(F.col(doc)) if kind == "binary" else F.col(doc).cast("string")
    rows = chunks.where(F.col(chunk).isNotNull()).select(
        F.coalesce(F.concat(F.lit("="), named), F.lit("")).alias("doc"), F.col(chunk).cast("long").alias("no"),
        body.alias("text"), F.coalesce(F.col(last), F.lit(False)).alias("last"), let(matches(body, pattern), facts).alias("f"),
    ).select("doc", "no", "text", "last", "f.*", F.pmod(F.xxhash64("doc"), F.lit(buckets)).alias("bucket"))
    step, start, most = stepper(n), START, FRAME_PIECES
    columns = ["doc", "no", "text", "last", "count", "tail", "begins", "ends"]

    def advance(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        frame_of = lambda rows: pd.DataFrame(rows, columns=["doc", "piece", "line", "col", "ord", "text", "before"])
        documents = {d[0]: d[1:] for d in json.loads(state.get[0])} if state.exists else {}
        waiting, out = {}, []
        for frame in frames:
            for name, no, text, last, count, tail, begins, ends in zip(*[frame[c].tolist() for c in columns]):
                now = documents.get(name)
                if now is None:
                    now = documents[name] = [*start[:6], [], []]
                if name not in waiting:
                    waiting[name] = {c[0]: c for c in now[7]}
                if no >= now[0] and no not in waiting[name]:
                    waiting[name][no] = [no, text, last, count, [str(t) for t in tail], begins, ends]
        for name, held in waiting.items():
            now, ended = documents[name], False
            while now[0] in held and not ended:
                taken = dict(zip(columns[1:], held.pop(now[0])))
                done = step(now, taken)
                if done is not None:
                    out.append((name, *done))
                ended = taken["last"]
            if ended:
                del documents[name]
            else:
                now[7] = [held[k] for k in sorted(held)]
            if len(out) >= most:
                yield frame_of(out)
                out = []
        if documents:
            state.update((json.dumps([[name, *now] for name, now in documents.items()], ensure_ascii=False),))
        elif state.exists:
            state.remove()
        yield frame_of(out)

    schema = "doc string, piece bigint, line int, col int, ord bigint, text string, before array<string>"
    cut = rows.groupBy("bucket").applyInPandasWithState(advance, schema, STATE, "append", "NoTimeout")
    name = F.substring("doc", 2, 2**31 - 1)
    back = F.unhex(name) if kind == "binary" else name.cast(chunks.schema[doc].dataType)
    return cut.withColumn("doc", F.when(F.col("doc") != "", back)).withColumnRenamed("doc", doc)


def chunk_tokens(
    chunks: DataFrame,
    doc: str = "doc_id",
    lower: bool = True,
    stop: StopWords = None,
    pattern: str = TOKEN_PATTERN,
    **names: str,
) -> DataFrame:
    """``doc_id, ord, norm, line, start, end``: the tokens of the joined text.

    Lines are counted through the document, offsets through the line, whatever the chunks.
    A stop list removes tokens and leaves the places of the others.
    """
    cut = pieces(chunks, 1, doc, pattern=pattern, **names)
    found = line_tokens(F.col("text"), pattern, lower, F.col("line"))
    listed = cut.select(doc, F.col("ord").alias("__ord"), F.col("line").alias("__line"), "col", found.alias("tokens"))
    rows = explode_tokens(listed, keep=(doc, "__ord", "__line", "col"))
    moved = F.when(F.col("line") == F.col("__line"), F.col("col")).otherwise(F.lit(0))
    rows = rows.select(
        doc, (F.col("__ord") + F.col("ord")).alias("ord"), "norm", "line",
        (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"),
    )
    words = _as_list(stop)
    if words:
        return rows.where(~F.col("norm").isin(*words))
    return remove_stop_words(rows, stop) if isinstance(stop, DataFrame) else rows


def chunk_ngrams(
    chunks: DataFrame, n: int, doc: str = "doc_id", lower: bool = True, pattern: str = TOKEN_PATTERN, **names: str
) -> DataFrame:
    """``doc_id, w1 … wn``: the n-grams of the joined text, also those across chunks."""
    cut = pieces(chunks, n, doc, pattern=pattern, **names)
    vector = F.concat("before", matches(F.col("text"), pattern))
    if lower:
        vector = F.transform(vector, F.lower)
    return ngrams(cut.select(doc, vector.alias("vector")), n, keep=(doc,))
