"""Secret scan: fixed patterns, and character models of random strings and identifiers.

Fixed patterns give the base spans. Beside them, every run of letters, digits and
``+/_=-`` of ``MIN_RUN`` characters or more is judged by two first-order Markov models of
its characters, one of random strings and one of ordinary identifiers: it is a secret if
the log-likelihood ratio per character is at least ``MIN_RATIO``. Of a run that base spans
touch, each part outside them is judged, of any length; its whole ratio must also reach
what the shortest run needs, since few characters tell little.

The models are trained from labelled samples: rows (text, secret). Their size is fixed
(``SYMBOLS`` squared), whatever the number of samples.

Defined cases: a null or empty text has no spans; texts are scanned whole; overlapping
candidates cannot arise; an empty sample gives a uniform model; repeated rows give
repeated results. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.workers import package_path

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Maximal runs: shorter ones would be dropped anyway.
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_VALUE, MIN_ACCESS = 12, 18

MIN_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
# Measured on held-out runs at two sizes, see README.
MIN_RATIO = 1.0
# Shares in the identifiers' model: of pairs after their first character, and of
# characters by frequency. A character seen BACKOFF times gives its pairs half of theirs.
PAIR_SHARE, CHAR_SHARE = 0.99, 0.9
BACKOFF = 5.0
SAMPLE_RUN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_INDEX = np.full(256, 0, np.int64)
for _i, _c in enumerate(SYMBOLS):
    _INDEX[ord(_c)] = _i + 1
SIZE = len(SYMBOLS) + 1  # 0 stands for the edge of a run


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_values(text: str) -> list[str]:
    """The strings that the fixed patterns hold to be secret."""
    return [ASSIGN.match(text, a)[2] if k == 0 else text[a:b] for a, k, b in base_spans(text)]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, start of run, end of run) of what base spans leave of each run."""
    out = []
    first = 0
    for m in RUN.finditer(text):
        # Spans are sorted by start and may nest: the first that can matter ends behind the run's start.
        while first < len(taken) and taken[first][2] <= m.start():
            first += 1
        at = m.start()
        for a, _, b in taken[first:]:
            if a >= m.end():
                break
            if a > at:
                out.append((at, a, m.start(), m.end()))
            at = max(at, b)
        if at < m.end():
            out.append((at, m.end(), m.start(), m.end()))
    return out


def _pairs(run: str) -> np.ndarray:
    at = _INDEX[np.frombuffer(run.encode("latin-1", "replace"), np.uint8)]
    padded = np.concatenate([[0], at, [0]])
    return padded[:-1] * SIZE + padded[1:]


@dataclass
class RandomnessModel:
    ratio: np.ndarray  # log-likelihood ratio of each character pair

    def score(self, run: str) -> float:
        """Log-likelihood ratio per character: positive is like a random string."""
        return float(self.ratio[_pairs(run)].sum() / (len(run) + 1))

    def score_part(self, run: str, start: int, stop: int) -> float:
        """The same of a part of a run, with the pairs that join it to the rest."""
        return float(self.ratio[_pairs(run)[start : stop + 1]].sum() / (stop - start + 1))


def fit(samples: DataFrame, text_col: str = "text", secret_col: str = "secret") -> RandomnessModel:
    """Count character pairs of all labelled samples and compare the two models."""
    package_path(samples.sparkSession)
    rows = samples.select(F.col(text_col).alias("t"), F.col(secret_col).cast("int").alias("s")).where(
        "t IS NOT NULL AND s IS NOT NULL"
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            for text, secret in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for run in SAMPLE_RUN.findall(text):
                    np.add.at(totals[secret], _pairs(run), 1)
        yield _counts(totals)

    return _model(rows.mapInArrow(count, COUNTS))


COUNTS = "secret int, pair int, n bigint"


def _counts(totals: np.ndarray) -> pa.RecordBatch:
    secret, pair = np.nonzero(totals)
    return pa.RecordBatch.from_arrays(
        [pa.array(secret, pa.int32()), pa.array(pair, pa.int32()), pa.array(totals[secret, pair], pa.int64())],
        names=["secret", "pair", "n"],
    )


def _model(counted: DataFrame) -> RandomnessModel:
    table = counted.groupBy("secret", "pair").agg(F.sum("n").alias("n")).toPandas()  # at most 2 x SIZE x SIZE rows
    totals = np.zeros((2, SIZE, SIZE))
    totals.reshape(2, -1)[table["secret"].to_numpy(int), table["pair"].to_numpy(int)] = table["n"].to_numpy()
    # Random strings may come in other alphabets than the samples': a share of all pairs
    # is taken as even. Identifiers keep fixed shares for pairs and characters they lack,
    # so that more samples do not make these less likely.
    seen = totals.sum(axis=2, keepdims=True)
    shares = totals / np.maximum(seen, 1)
    secret = 0.7 * np.where(seen[1] > 0, shares[1], 1 / SIZE) + 0.3 / SIZE
    single = CHAR_SHARE * totals[0].sum(axis=0) / max(totals[0].sum(), 1) + (1 - CHAR_SHARE) / SIZE
    if not totals[0].any():
        single[:] = 1 / SIZE
    pairs = PAIR_SHARE * seen[0] / (seen[0] + BACKOFF)
    plain = pairs * shares[0] + (1 - pairs) * single
    return RandomnessModel(np.log(secret / plain).reshape(-1))


def fit_on_documents(docs: DataFrame, text_col: str = "text") -> RandomnessModel:
    """Train on the corpus itself: values in base spans are random strings, other runs identifiers.

    Labels and counts are made in one pass over all texts.
    """
    package_path(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, SIZE * SIZE), np.int64)
        for batch in batches:
            runs: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
            for item in batch.column(0):
                text = item.as_py() or ""
                spans = base_spans(text)
                cut, at = [], 0
                for a, _, b in spans:
                    cut.append(text[at:a])
                    at = max(at, b)
                cut.append(text[at:])
                plain = " ".join(SAMPLE_RUN.findall(" ".join(cut)))
                if plain:
                    runs[0].append(_INDEX[np.frombuffer(f" {plain} ".encode("latin-1", "replace"), np.uint8)])
                for value in secret_values(text) if spans else ():
                    runs[1].append(_INDEX[np.frombuffer(f" {value} ".encode("latin-1", "replace"), np.uint8)])
            for secret in (0, 1):
                if runs[secret]:
                    line = np.concatenate(runs[secret])
                    pairs = line[:-1] * SIZE + line[1:]
                    totals[secret] += np.bincount(pairs[pairs > 0], minlength=SIZE * SIZE)
        yield _counts(totals)

    return _model(docs.select(F.col(text_col)).mapInArrow(count, COUNTS))


def scan(
    docs: DataFrame, model: RandomnessModel, id_col: str = "doc_id", text_col: str = "text", min_ratio: float = MIN_RATIO
) -> DataFrame:
    """Per document: id and its spans (start, kind, end, ratio), by start, then kind.

    ``ratio`` is null for the fixed patterns.
    """
    package_path(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("ratio", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            spans = []
            for item in batch.column(1):
                text = item.as_py() or ""
                base = base_spans(text)
                rows = [(a, k, b, None) for a, k, b in base]
                for a, b, lo, hi in candidates(text, base):
                    ratio = judge.score_part(text[lo:hi], a - lo, b - lo)
                    if ratio >= min_ratio and ratio * (b - a + 1) >= min_ratio * (MIN_RUN + 1):
                        rows.append((a, 3, b, ratio))
                rows.sort(key=lambda r: r[:3])
                spans.append([{"start": a, "kind": KINDS[k], "end": b, "ratio": r} for a, k, b, r in rows])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=[id_col, "spans"])

    schema = f"`{id_col}` {kind}, spans array<struct<start:int,kind:string,end:int,ratio:double>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
