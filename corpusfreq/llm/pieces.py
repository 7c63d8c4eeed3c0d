"""SentencePiece BPE encoding by a table of prefixes.

A text's encoding is valid exactly if each two neighbouring tokens are compatible:
encoding their joined string gives the two back. So every prefix has one last token,
the one among the automaton's matches ending there that is compatible with the last
token of the prefix before it. One pass stores these last tokens; the ids are then
read off backwards from the end.

No piece holds a space mark after another character, so a run of space marks with
the word behind it is encoded by itself, and frequent words are kept in a bounded
memo. Characters outside the vocabulary become byte tokens, which join with nothing.

Defined cases: a null text is encoded like an empty one, to no ids; texts of any length
are encoded whole; repeated rows are encoded alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.wordwise import packed
from corpusfreq.llm.workers import held, package_path, task

MARK = "▁"
# Words and tested pairs kept by a worker. A full memo of words becomes the old one.
MEMO_WORDS = 300_000
LEAN_WORDS = 50_000
MEMO_PAIRS = 300_000
# Words longer than this are encoded without keeping them.
MEMO_CHARS = 64
CHUNK = re.compile(f"{MARK}*[^{MARK}]*")


class PieceEncoder:
    """Encoder of one worker for a BPE model with byte fallback."""

    def __init__(self, model_file: str, words: int | None = None):
        self.words = words or MEMO_WORDS
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = self.model.get_piece_size()
        special = lambda i: self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)
        pieces = [(i, self.model.id_to_piece(i)) for i in range(size) if not special(i)]
        if any(MARK in p.lstrip(MARK) for _, p in pieces):
            raise ValueError("a piece crosses a word boundary")
        if any(self.model.is_unused(i) for i, _ in pieces):
            raise ValueError("unused pieces are not supported")
        self.score = {p: self.model.get_score(i) for i, p in pieces}
        self.text = dict(pieces)
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # A piece that its own string does not encode to can never be a token.
        self.automaton = ahocorasick.Automaton()
        for i, p in pieces:
            if self._merge(list(p)) == [p]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        # Two neighbouring characters that no piece holds always part two tokens.
        self.joints = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.size = size
        self.pairs: dict[int, bool] = {}
        self.decimal = [str(i) for i in range(size)]
        # Packed ids, by parts of words and by words without their own space mark: a fourth
        # of the memory of lists under the marked words.
        self.parts: dict[str, bytes] = {}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _merge(self, parts: list[str]) -> list[str]:
        """Join the best-scored neighbours, the leftmost first, until none is a piece."""
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined string is encoded to just these two."""
        a, b = self.text[left], self.text[right]
        known = a + b not in self.score and self._merge(list(a + b)) == [a, b]
        if len(self.pairs) >= MEMO_PAIRS:
            self.pairs.clear()
        self.pairs[left * self.size + right] = known
        return known

    def _part(self, part: str) -> bytes:
        """Packed ids of a part of a word: fill the prefix table, then walk it backwards."""
        n = len(part)
        last = [-1] * (n + 1)  # last token of each prefix; -1: the bytes of a character
        width = [0] * (n + 1)
        known, size = self.pairs.get, self.size
        filled = 0
        for end, (token, length) in self.automaton.iter(part):
            stop = end + 1
            if width[stop]:
                continue
            while filled < end:  # no piece ends there: characters outside the vocabulary
                filled += 1
                if not width[filled]:
                    width[filled] = 1
            start = stop - length
            before = last[start]
            if before >= 0:
                fits = known(before * size + token)
                if not (self.compatible(before, token) if fits is None else fits):
                    continue
            last[stop], width[stop] = token, length
        while filled < n:
            filled += 1
            if not width[filled]:
                width[filled] = 1
        out: list[int] = []
        at = n
        while at:
            if last[at] < 0:
                out.extend(self.bytes[b] for b in reversed(part[at - 1].encode("utf-8")))
            else:
                out.append(last[at])
            at -= width[at]
        out.reverse()
        return packed(out)

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of one word with its space marks, cut where no piece holds both neighbours."""
        joints, parts, out, begin = self.joints, self.parts, [], 0
        for i in range(1, len(chunk) + 1):
            if chunk[i - 1 : i + 1] not in joints:
                part = chunk[begin:i]
                begin = i
                ids = parts.get(part)
                if ids is None:
                    ids = self._part(part)
                    if len(part) <= MEMO_CHARS:
                        if len(parts) >= self.words:
                            parts.clear()
                        parts[part] = ids
                out.append(ids)
        return b"".join(out)

    def _remembered(self, word: str) -> bytes:
        """The ids of a word that the young memo lacks: from the old one, or made anew."""
        ids = self.old.get(word)
        if ids is None:
            ids = self._chunk(MARK + word)
        if len(word) < MEMO_CHARS:
            if len(self.memo) >= self.words:
                self.old, self.memo = self.memo, {}
            self.memo[word] = ids
        return ids

    def forget(self) -> None:
        """Drop what is remembered of texts; the model's own tables stay."""
        self.pairs, self.parts, self.memo, self.old = {}, {}, {}, {}

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        # Every word but the first has one space mark of its own.
        marked = (MARK + text).replace(" ", MARK)
        if MARK + MARK in marked:
            words = [c[1:] for c in CHUNK.findall(marked) if c]
        else:
            words = marked[1:].split(MARK)
        memo, found = self.memo, []
        for word in words:
            ids = memo.get(word)
            if ids is None:
                ids = self._remembered(word)
                memo = self.memo
            found.append(ids)
        return np.frombuffer(b"".join(found), np.int32).tolist()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as decimals, SHA-256 of the decoded text."""
        ids, decimal = self.encode(text), self.decimal
        listed = ",".join([decimal[i] for i in ids])
        decoded = self.model.decode(ids) if ids else ""
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        return len(ids), sha(listed), sha(decoded)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids) if ids else ""


def encoder(model_file: str, words: int = LEAN_WORDS) -> PieceEncoder:
    """The worker's encoder; workers are reused, so its tables are built once."""
    return held("pieces", f"{words} {model_file}", lambda: PieceEncoder(model_file, words))


def _map(docs: DataFrame, model_file: str, id_col: str, text_col: str, kind: list, columns: str, row, lean: bool = False) -> DataFrame:
    """One output row per document; ``row(text)`` gives its values after the id."""
    package_path(docs.sparkSession)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {columns}"

    @task("pieces")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                rows = [row(t.as_py()) for t in texts.slice(lo, 256)]
                values = [pa.array(list(c), type=t) for c, t in zip(zip(*rows), kind, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), *values], names=[id_col, *names])
        if lean:  # idle workers hold no words: an executor has more of them than cores
            encoder(model_file).forget()

    names = [part.strip().split(" ")[0] for part in columns.split(",")]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``ids``, the whole text's token ids."""

    def row(text):
        return (encoder(model_file).encode(text or ""),)

    return _map(docs, model_file, id_col, text_col, [pa.list_(pa.int32())], "ids array<int>", row)


def decode_documents(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id and ``text`` of its token ids."""

    def row(ids):
        return (encoder(model_file).decode(ids or []),)

    return _map(encoded, model_file, id_col, ids_col, [pa.string()], "text string", row)


def digest_documents(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", lean: bool = False
) -> DataFrame:
    """Per document: id, n_tokens, and digests of the ids and of the text decoded from them.

    ``lean`` workers keep fewer words, and none between tasks, for executors that have
    little memory left; they encode some words again.
    """

    words = LEAN_WORDS if lean else MEMO_WORDS

    def row(text):
        return encoder(model_file, words).digest(text or "")

    kind = [pa.int64(), pa.string(), pa.string()]
    return _map(docs, model_file, id_col, text_col, kind, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row, lean)
