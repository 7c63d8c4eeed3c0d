"""The Merkle manifest against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusfreq.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, id long, digest string, `group` string, pos int, size int"


def h(*inputs):
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return h(*(field(v) for v in row))


def levels_of(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 2]) for i in range(0, len(rows[-1]), 2)])
    return rows


def climb(levels, at, node):
    """(siblings, root reached) from a leaf's place."""
    found = []
    for row in levels[:-1]:
        run = [node if k == at else row[k] for k in range(at - at % 2, min(at - at % 2 + 2, len(row)))]
        found += [x for k, x in enumerate(run) if k != at % 2]
        node, at = h(*run), at // 2
    return found, node


def brute(rows):
    by_lang = defaultdict(list)
    for row in rows:
        by_lang[row[2]].append(row)
    trees = {}
    for lang, own in by_lang.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = levels_of([leaf(r) for r in own])
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    top = levels_of([trees[x][-1][0] for x in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, row in enumerate(by_lang[lang]):
            mine, other = leaf(row), leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                other = leaf((*row[:3], row[3] + 1, row[4]))
            below, reached = climb(trees[lang], at, other)
            above, root = climb(top, place, reached)
            want = top[-1][0]
            out.append((row[0], mine, trees[lang][-1][0], want, h(*below, *above), root, root == want))
    return Counter(out)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 5, "x", "y", 1, 2) for r in rows], SCHEMA).repartition(4)
    manifest = merkle.build(merkle.rows_of(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 0))
    return manifest, merkle.proofs(manifest)


def rows_like(sizes, rnd):
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows) * 3 + 1, rnd.choice(["a", None, "b:c"]), lang, rnd.choice([None, 0, 9, 99]), rnd.choice(["", None, "é" * 3, "x y", "t" * 2000])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("height", [1, 8])
def test_proofs(spark, monkeypatch, height):
    """Groups of one to many blocks, one of them most of the rows; every shape of last run."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "height_of", lambda size: min(height, (size - 1).bit_length()))
    rows = rows_like({"en": 700, None: 5, "de": 1, "é": 3, "": 2, "=": 17, "-": 4}, random.Random(height))
    rows += [(2, None, "en", None, None)] * 3 + [(2, "s", "en", 9223372036854775807, "z"), (None, "s", "en", 1, "null id"), (None, None, None, None, None)]
    manifest, proofs = found(spark, rows)
    got = proofs.collect()
    assert proofs.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got)) == brute(rows)
    assert {r["verified"] for r in got} == {True, False}
    assert manifest.root().collect()[0]["root"] == got[0]["root"]
    assert {r["subroot"] for r in manifest.subroots().collect()} == {r["subroot"] for r in got}
    assert {r["group"] for r in manifest.subroots().collect()} == {r[2] for r in rows}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = rows_like({"en": n}, random.Random(1))
    _, proofs = found(spark, rows)
    assert Counter(map(tuple, proofs.collect())) == brute(rows)


def test_addresses_are_a_layout_in_halves():
    assert [[int(x) for x in merkle.address(4, d, np.arange(1 << d))] for d in range(4)] == [
        [0], [1, 2], [3, 6, 9, 12], [4, 5, 7, 8, 10, 11, 13, 14]
    ]
    for levels in range(1, 10):
        places = np.concatenate([merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)])
        assert sorted(places.tolist()) == list(range((1 << levels) - 1))
    # A path of the whole block stays within few neighbourhoods of any length.
    deep = [int(merkle.address(9, d, np.arange(1 << d))[0]) for d in range(9)]
    assert len({p // 16 for p in deep}) <= 4


def test_a_changed_value_changes_only_its_own_proof(spark):
    rows = rows_like({"en": 600, "fr": 40}, random.Random(4))
    _, proofs = found(spark, rows)
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None}
    assert {r["id"] for r in proofs.where("NOT verified").collect()} == changed
