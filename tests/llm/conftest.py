import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, node long, w string, host string"


@pytest.fixture(scope="session")
def prose():
    """Seeded pseudo-prose: words of syllables, some repeated lines, near and exact copies."""
    rnd = random.Random(5)
    syllables = ["an", "the", "or", "ing", "ed", "st", "ou", "er", "ha", "ti", "é", "ö"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(400)]

    def text(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    texts = [text(rnd.choice([1, 2, 3, 5, 8, 13, 14, 20, 60, 150])) for _ in range(120)]
    for i in range(40):
        parts = texts[rnd.randrange(120)].split(" ")
        for _ in range(max(1, len(parts) // 40)):
            parts[rnd.randrange(len(parts))] = rnd.choice(words)
        texts.append(" ".join(parts))
    for i in range(20):
        texts.append(texts[rnd.randrange(120)].upper())
    for n in (6, 7, 8, 9, 10, 11, 12, 14, 17, 22):
        base = text(n)
        texts += [base, base + " the", "or " + base, base.rsplit(" ", 1)[0]]
    return texts


@pytest.fixture(scope="session")
def docs(spark, prose):
    """Documents with nulls, empty and long texts, repeated rows and columns of clashing names."""
    rows = [(i, t, "en", f"s{i % 3}", len(t), "x", i, "y", "z") for i, t in enumerate(prose)]
    odd = [None, "", "  \n ", "1 2", "...", " ".join(f"w{k % 700}" for k in range(30_000))]
    rows += [(1000 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(odd)]
    rows += [rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
