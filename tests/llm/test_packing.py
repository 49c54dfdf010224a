import random
import zlib

import llm_rows
import numpy as np
import pytest
from runlens.llm import packing, vocabulary

TOKENIZER = vocabulary.tokenizer(vocabulary.read())


def ids(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check_sequences(pieces, capacity):
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p["sequence"], []).append((p["offset"], p["length"]))
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity", [1024, 16, 1])
def test_odd_rows(spark, capacity):
    docs = llm_rows.odd_documents(spark).repartition(3)
    got = packing.pack(docs, capacity=capacity, keep_ids=True).collect()
    check_sequences(got, capacity)
    want = sorted(
        [
            (r[0], start, len(part), zlib.crc32(part.tobytes()), len(all_ids), part.tobytes())
            for r in llm_rows.odd_rows()
            for all_ids in [ids(r[1])]
            for start in range(0, len(all_ids), capacity)
            for part in [all_ids[start : start + capacity]]
        ],
        key=repr,
    )
    fields = ("id", "start", "length", "crc", "tokens")
    assert sorted([(*(p[f] for f in fields), bytes(p["ids"])) for p in got], key=repr) == want


def test_empty_table(spark):
    assert packing.pack(llm_rows.no_documents(spark)).collect() == []


def test_little_padding(spark):
    rng = random.Random(3)
    rows = [(i, llm_rows.prose(i, rng.randrange(1, 900))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n = check_sequences(got, 1024)
    assert sum(p["length"] for p in got) > 0.97 * 1024 * n


def test_fill_is_the_closest_one():
    rng = random.Random(5)
    for _ in range(200):
        room = rng.randrange(1, 40)
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.closest_fill(counts, room)
        assert all(n <= counts[length] for length, n in used.items())
        assert sum(length * n for length, n in used.items()) == max(s for s in sums if s <= room)


def test_fills_use_up_every_count():
    rng = random.Random(6)
    counts = {length: rng.randrange(0, 10**6) for length in range(1, 128)}
    used = {}
    for fill in packing.fills(counts, 128):
        assert sum(length * n for length, n in fill.members) <= 128
        for length, n in fill.members:
            used[length] = used.get(length, 0) + n * fill.repeats
    assert used == {length: n for length, n in counts.items() if n}


def test_both_libraries_give_the_same_ids():
    fast = vocabulary.encoding(vocabulary.read_ranks(), vocabulary.PATTERN)
    probes = [f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x20000 or c % 50 == 0)]
    probes += [r[1] or "" for r in llm_rows.odd_rows()]
    for text, want in zip(probes, TOKENIZER.encode_batch(probes, add_special_tokens=False)):
        assert fast.encode(text, allowed_special="all") == want.ids


def test_a_million_blanks(spark):
    texts = [" " * 10**6, "\n" * 10**6, "a" + " \n\t" * 400_000 + "b", "\u3000" * 10**6, "plain", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = packing.pack(docs, keep_ids=True).collect()
    data = {}
    for p in sorted(got, key=lambda p: p["start"]):
        data[p["id"]] = data.get(p["id"], b"") + bytes(p["ids"])
    assert data == {i: ids(text).tobytes() for i, text in enumerate(texts)}
