import random
from collections import defaultdict

import llm_rows
import numpy as np
import pytest
from runlens.llm import common, near_dedup
from runlens.llm.shingles import shingle_sets


def sets_of(text, words):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        found = found.replace(blank, " ")
    found = [w for w in found.split(" ") if w]
    if not found:
        return frozenset()
    width = min(words, len(found))
    return frozenset(tuple(found[i : i + width]) for i in range(len(found) - width + 1))


def expected(rows, words, percent):
    """(id, size, component) by comparing all pairs."""
    sets = [sets_of(t, words) for _, t in rows]
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                part[find(i)] = find(j)
    smallest = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        smallest[find(i)].append(doc_id)
    first = {p: min((x for x in ids if x is not None), default=None) for p, ids in smallest.items()}
    return sorted([(d, len(s), first[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=repr)


def check(rows, docs, words=5, percent=80):
    got = near_dedup.near_duplicates(docs, words=words, percent=percent).collect()
    assert sorted([(r["id"], r["n_shingles"], r["component_id"]) for r in got], key=repr) == expected(rows, words, percent)
    assert all(r["id"] == r["component_id"] for r in got if r["kept"])
    return got


def edited(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def family_rows():
    rng = random.Random(2)
    rows = []
    for f in range(25):
        base = " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([6, 30, 120, 300])))
        for copy in range(rng.choice([1, 2, 12])):
            rows.append((len(rows), edited(base, rng, copy % 5)))
    # A chain: each is similar to the next one only, in the end.
    words = [f"c{i}" for i in range(400)]
    for step in range(0, 200, 15):
        rows.append((len(rows), " ".join(words[step : step + 200])))
    # Documents that share a passage but are not alike.
    passage = " ".join(f"p{i}" for i in range(100))
    rows += [(len(rows) + i, f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60))) for i in range(40)]
    return rows


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in llm_rows.odd_rows()]
    got = check(rows, llm_rows.odd_documents(spark))
    assert sum(r["kept"] for r in got) == len({(r["component_id"], r["n_shingles"] == 0 and r["id"]) for r in got}) + 1


def test_empty_table(spark):
    assert near_dedup.near_duplicates(llm_rows.no_documents(spark)).collect() == []


@pytest.mark.parametrize(("words", "blocks"), [(4, None), (5, 3)])
def test_families_chains_and_passages(spark, monkeypatch, words, blocks):
    if blocks:  # many blocks per list and cluster
        monkeypatch.setattr(near_dedup, "BLOCK_SIGNATURES", blocks)
        monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 500)
    rows = family_rows()
    check(rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words)


def test_keep_one_each(spark):
    docs = llm_rows.odd_documents(spark)
    kept = near_dedup.keep_one_each(docs)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert set(rows) <= {tuple(r) for r in docs.collect()}
    texts = [r[1] for r in rows]
    assert texts.count(llm_rows.prose(1, 80)) == 1 and texts.count(llm_rows.prose(3, 60)) == 1
    assert {r[0] for r in rows} >= {3, 4, 5, 6, 7, 8}


def test_shingles_of_one_text_do_not_depend_on_the_others():
    texts = [llm_rows.prose(i, n) for i, n in enumerate((1, 3, 4, 50, 400))]
    together = list(shingle_sets(texts, 4))
    assert [len(s) for s in together] == [len(sets_of(t, 4)) for t in texts]
    for text, found in zip(texts, together):
        assert np.array_equal(found, next(shingle_sets([text], 4)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(40)] + [(300, 300)]
    edges += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)]
    part = {}

    def find(x):
        while part.get(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    found = common.components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert len({r["node"] for r in found}) == len(found)
    assert {r["node"]: r["component"] for r in found} == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}
