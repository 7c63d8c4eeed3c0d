"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed
byte n-grams separates the languages that have the bit from those that lack it; its
weights are log-ratios of n-gram frequencies counted over all learning rows. A text's
bit margins are compared with every codeword by a loss weighted with the separating
power of the bit, and the codeword of least loss wins.

The model has (bits x ``BUCKETS``) numbers whatever the number of documents, and bits grow
with the logarithm of the number of languages. Counts by language come to the driver for up
to ``MAX_TABLE`` languages; of more, Spark adds up the shares of each bit's two sides and
only these sums come.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no
learning rows every text is ``und``; rows with null language or text teach nothing;
equal losses go to the language first in order; repeated rows are judged alike; texts are
read whole. Other columns are not read; columns that are kept may have any names but those
of the answers.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusfreq.llm.bytes_np import LOWER, chunks
from corpusfreq.llm.store import stored
from corpusfreq.llm.workers import package_path, task

BUCKETS = 1 << 15
MAX_TABLE = 200
# Of so many random codes the one whose nearest codewords are farthest apart is taken.
TRIED_CODES = 16
COMPARED_CODES = 2000
# Up to this many languages all distinct splits of them are bits.
EXHAUSTIVE = 6
UNKNOWN = "und"
# Nearest codewords closer than this (in score) make a text ambiguous.
AMBIGUOUS = 0.02

# ASCII letters in lower case; every other ASCII byte counts as a blank.
_FOLD = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 32).astype(np.uint32)


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the byte trigram that ends at each byte; a text starts after a blank."""
    b = _FOLD[data]
    before, first = np.empty_like(b), np.empty_like(b)
    before[1:], before[:1] = b[:-1], 32
    first[2:], first[:2] = b[:-2], 32
    begins = offsets[:-1][offsets[:-1] < len(data)]
    before[begins], first[begins] = 32, 32
    seconds = begins + 1
    first[seconds[seconds < len(data)]] = 32
    key = (first << np.uint32(16) | before << np.uint32(8) | b) * np.uint32(2654435761)
    return key >> np.uint32(32 - 15)


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each text's bytes."""
    sums = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        sums[full] = np.add.reduceat(values, offsets[full])
    return sums


@dataclass
class LanguageCode:
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # bits x buckets
    power: np.ndarray  # of each bit, sums to 1


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 bits per language, any two rows far apart."""
    if n <= EXHAUSTIVE:
        splits = [s for k in range(1, n) for s in itertools.combinations(range(n), k) if 0 in s]
        code = -np.ones((n, len(splits)))
        for bit, split in enumerate(splits):
            code[list(split), bit] = 1
        return code
    bits = 10 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for seed in range(TRIED_CODES if n <= COMPARED_CODES else 1):
        code = np.random.default_rng(7 + seed).choice([-1.0, 1.0], (n, bits))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        if n > COMPARED_CODES:
            return code
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        distance = (code.shape[1] - agree.max()) / 2
        if distance > apart:
            best, apart = code, distance
    return best


def fit(learning: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageCode:
    """Count n-grams by language over all rows of ``learning`` and derive the bits' weights."""
    package_path(learning.sparkSession)
    rows = learning.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("t IS NOT NULL AND l IS NOT NULL")

    @task("langid")
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, data, offsets in chunks(batch.column(0)):
                names = sorted(set(langs[lo:hi]))
                at = {name: i for i, name in enumerate(names)}
                which = np.array([at[x] for x in langs[lo:hi]])
                flat = np.repeat(which, np.diff(offsets)) * BUCKETS + _grams(data, offsets)
                found = np.bincount(flat, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for name, counts in zip(names, found, strict=True):
                    totals[name] = totals.get(name, 0) + counts
        for name, counts in totals.items():
            full = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(counts[full], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    counted = rows.mapInArrow(count, "lang string, bucket int, n bigint")
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = stored(summed, "grams")
    sizes = {r["lang"]: r["n"] for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sizes)
    codes = codewords(len(languages)) if languages else np.zeros((0, 0))
    means = _means_on_driver if len(languages) <= MAX_TABLE else _means_in_spark
    weights, power = [], []
    for yes, no in means(summed, languages, sizes, codes):
        ratio = np.log(yes / no)
        weights.append(ratio)
        power.append(((yes - no) * ratio).sum())
    power = np.array(power)
    return LanguageCode(languages, codes, np.array(weights), power / power.sum() if len(power) else power)


# The share of a bucket in a language is (count + 0.5) / (all counts + 0.5 x buckets).


def _means_on_driver(summed: DataFrame, languages: list[str], sizes: dict[str, int], codes: np.ndarray):
    """Mean shares of the languages with and without each bit; at most MAX_TABLE x BUCKETS counts."""
    table = summed.toPandas()
    share = np.full((len(languages), BUCKETS), 0.5)
    place = table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int)
    if len(table):
        share[place, table["bucket"].to_numpy()] += table["n"].to_numpy()
    share /= share.sum(axis=1, keepdims=True)
    for bit in codes.T:
        yield share[bit > 0].mean(axis=0), share[bit < 0].mean(axis=0)


def _means_in_spark(summed: DataFrame, languages: list[str], sizes: dict[str, int], codes: np.ndarray):
    """The same from sums over the languages, one row for each bucket."""
    total = np.array([sizes[x] + 0.5 * BUCKETS for x in languages])
    rows = [(x, float(t), [float(v) for v in code]) for x, t, code in zip(languages, total, codes, strict=True)]
    known = summed.sparkSession.createDataFrame(rows, "l string, total double, code array<double>")
    shares = summed.join(F.broadcast(known), F.col("lang") == F.col("l")).withColumn("share", F.col("n") / F.col("total"))
    parts = [F.sum(F.when(F.get("code", F.lit(k)) > 0, F.col("share"))).alias(f"y{k}") for k in range(codes.shape[1])]
    found = shares.groupBy("bucket").agg(F.sum("share").alias("all"), *parts).na.fill(0.0).toPandas()
    at = found["bucket"].to_numpy()
    every = np.zeros(BUCKETS)
    every[at] = found["all"].to_numpy()
    for k, bit in enumerate(codes.T):
        sums = np.zeros(BUCKETS)
        sums[at] = found[f"y{k}"].to_numpy()
        yes = (sums + (0.5 / total[bit > 0]).sum()) / (bit > 0).sum()
        no = (np.maximum(every - sums, 0.0) + (0.5 / total[bit < 0]).sum()) / (bit < 0).sum()
        yield yes, no


def _decode(model: LanguageCode, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, ambiguous) for each row of bit margins."""
    loss = np.zeros((len(margins), len(model.languages)))
    for i, code in enumerate(model.codes):
        loss[:, i] = (np.logaddexp(0, -margins * code) * model.power).sum(axis=1)
    best = loss.argmin(axis=1)
    likely = np.exp(loss.min(axis=1, keepdims=True) - loss)
    likely /= likely.sum(axis=1, keepdims=True)
    likely.sort(axis=1)
    second = likely[:, -2] if likely.shape[1] > 1 else 0.0
    return best, likely[:, -1], likely[:, -1] - second < AMBIGUOUS


def _judge(code: LanguageCode, texts: pa.Array) -> list[pa.Array]:
    """Language, score and ambiguity of every text of an array."""
    labels = np.array([*code.languages, UNKNOWN], dtype=object)
    names, scores, doubts = [], [], []
    for lo, hi, data, offsets in chunks(texts):
        n = hi - lo
        best, score, unsure = np.full(n, len(code.languages)), np.zeros(n), np.zeros(n, bool)
        if len(code.languages) == 1:
            best[:], score[:] = 0, 1.0
        elif code.languages:
            at = _grams(data, offsets)
            # Evidence grows with the text, but slower than its length.
            scale = np.maximum(np.diff(offsets), 1) ** -0.5
            margins = np.stack([_per_text(w[at], offsets) * scale for w in code.weights], axis=1)
            best, score, unsure = _decode(code, margins)
        lettered = _FOLD[data] != 32
        letters = _per_text(lettered.astype(float), offsets) > 0
        plain = _per_text((lettered & (data < 128)).astype(float), offsets) > 0
        for i in np.flatnonzero(letters & ~plain):
            letters[i] = any(c.isalpha() for c in texts[lo + int(i)].as_py())
        names.append(labels[np.where(letters, best, len(code.languages))])
        scores.append(np.where(letters, score, 0.0))
        doubts.append(unsure & letters)
    if not names:
        return [pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.bool_())]
    return [pa.array(np.concatenate(names), pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(doubts))]


def predict(
    docs: DataFrame, model: LanguageCode, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
    names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"),
) -> DataFrame:
    """The columns ``keep``, then predicted language, score (0 to 1) and ambiguity.

    Only the text goes to the Python worker and only the three answers come back.
    """
    package_path(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_judge(shared.value, texts), names=["lang", "score", "unsure"])

    answer = F.arrow_udf(judge, "struct<lang:string,score:double,unsure:boolean>")(F.col(text_col))
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    judged = docs.select(*kept, answer.alias("answer"))
    return judged.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        *[F.col("answer")[part].alias(name) for part, name in zip(("lang", "score", "unsure"), names, strict=True)],
    )
