"""Awkward rows that every operator has to take."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "id long, key string, kept boolean, doc string, copy int, n int, part string, _row long, _key string, label int"
)
WORDS = "alpha beta gamma delta river stone copper silent window market signal garden winter letter bridge".split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "s"]) for _ in range(words))


def odd_rows() -> list[tuple]:
    texts = [
        (0, prose(1, 80)), (1, prose(1, 80)), (2, prose(1, 80).replace(" ", "\t\n")), (3, None), (4, ""), (5, " \n\t "),
        (6, prose(2, 30000)), (7, "one"), (8, "one two"), (9, prose(3, 60)), (9, prose(3, 60)), (9, prose(4, 60)),
        (None, prose(5, 50)), (None, prose(5, 50)), (None, None), (10, "日本語 <|endoftext|> naïve \x1c\x85 ﷺ 😀" * 3),
        (11, "a" * 5000), (12, " " * 3000), (13, prose(1, 80).upper()), (14, "x\r\n\r\n  y  "), (15, "It's 'S ''s I'LL we'll"),
    ]
    rows = []
    for i, (doc_id, text) in enumerate(texts):
        source = None if i % 5 == 4 else f"src{i % 3}"
        lang = None if i % 4 == 3 else "en"
        rows.append((doc_id, text, lang, source, None if i % 2 else 7, 99, None, False, "d", 5, 6, "p", 7, "k", None))
    return rows


def odd_documents(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
