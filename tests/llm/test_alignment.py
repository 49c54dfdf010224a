import random
from collections import Counter

import llm_rows
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from runlens.llm import alignment, vocabulary
from tokenizers import Tokenizer
from tokenizers.decoders import ByteLevel

VOCAB_A = vocabulary.read()
VOCAB_B = open(public_tokenizers.path(alignment.B), "rb").read()
TOKENIZER = Tokenizer.from_str(VOCAB_A)
TOKENIZER.encode_special_tokens = True
FILES = alignment.vocabularies(None, None)
MODEL = sentencepiece.SentencePieceProcessor(model_proto=VOCAB_B)
CHARS = {}


def bytes_a(i):
    """Bytes of a byte-level token, from the library's own decoder for whole characters, else from its alphabet."""
    if not CHARS:
        # Every byte occurs in some character; the alphabet's n-th character is found by encoding it.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        CHARS.update({chr(b): b for b in plain})
        CHARS.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)})
    text = TOKENIZER.id_to_token(i)
    return text.encode() if i == 50256 else bytes(CHARS[c] for c in text)


def bytes_b(i):
    piece = MODEL.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if MODEL.is_byte(i) else piece.replace("▁", " ").encode()


def plain(text):
    """(ids of A, ids of B, links as pairs, groups as text) by stepping through one text."""
    nothing = ([], [], [], "")
    if not text:
        return nothing
    a = TOKENIZER.encode(" " + text, add_special_tokens=False).ids
    b = MODEL.encode(text)
    if any(b"".join(map(f, x)) != (" " + text).encode() for f, x in ((bytes_a, a), (bytes_b, b))):
        return nothing
    ends_a, ends_b = (np.cumsum([len(f(i)) for i in x]).tolist() for f, x in ((bytes_a, a), (bytes_b, b)))
    links = [(x, y) for x, e in zip(a, ends_a) for y, f in zip(b, ends_b) if e == f] if len(a) < 400 else None
    if links is None:
        at_b = dict(zip(ends_b, b))
        links = [(x, at_b[e]) for x, e in zip(a, ends_a) if e in at_b]
    cuts = sorted(set(ends_a) & set(ends_b))
    groups, last = [], 0
    sorted_a, sorted_b = iter(zip(a, ends_a)), iter(zip(b, ends_b))
    for cut in cuts:
        parts = []
        for side in (sorted_a, sorted_b):
            ids = []
            for i, end in side:
                ids.append(str(i))
                if end == cut:
                    break
            parts.append(",".join(ids))
        groups.append("|".join(parts))
        last = cut
    assert last == len((" " + text).encode())
    return a, b, links, ";".join(groups)


TEXTS = st.text(
    st.one_of(st.characters(codec="utf-8"), st.sampled_from("  \n\t'sdlvret1!\x85\xa0▁<|endoftext|></s>é日本😀")), max_size=80
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.none()), max_size=6), st.sampled_from([1, 2, 7, 1024]), st.sampled_from([FILES, FILES._replace(ranks=None)]))
def test_blocks_of_texts_against_brute_force(texts, stretch, files):
    got = alignment.align_texts(texts, files, stretch)
    for i, text in enumerate(texts):
        a, b, links, groups = plain(text)
        cut = slice(got.starts[i], got.starts[i + 1])
        assert (got.n_a[i], got.n_b[i]) == (len(a), len(b))
        assert list(zip(got.a[cut].tolist(), got.b[cut].tolist())) == links
        assert got.groups[i] == groups


def test_lockstep_merge_of_any_ends():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 2, 5, 40, 300]) for _ in range(rng.randint(1, 6))]
        ends = []
        for _ in range(2):
            ends.append([sorted(rng.sample(range(1, n), rng.randint(0, max(0, n - 1))) if n > 1 else []) + [n] * (n > 0) for n in sizes])
        starts = [np.concatenate([[0], np.cumsum([len(x) for x in side])]) for side in ends]
        flat = [np.array(sum(side, []), dtype=np.int64) for side in ends]
        cut_a, cut_b = alignment.merge(flat[0], starts[0], flat[1], starts[1], rng.choice([1, 3, 16, 1000]))
        want = [
            (starts[0][t] + i, starts[1][t] + ends[1][t].index(e))
            for t in range(len(sizes)) for i, e in enumerate(ends[0][t]) if e in ends[1][t]
        ]
        assert list(zip(cut_a.tolist(), cut_b.tolist())) == want


def expected(rows):
    found = [(i, plain(t)) for i, t in rows]
    counts = Counter(pair for _, f in found for pair in f[2])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for i, (a, b, links, groups) in found:
        best = sum(counts[p] == top[p[1]] for p in links)
        out.append((i, len(a), len(b), len(links), groups, best, sum(counts[p] for p in links)))
    return sorted(out, key=repr), counts, top


@pytest.mark.parametrize("size", [1, 200, alignment.LINKS])
def test_odd_rows(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "LINKS", size)
    docs = llm_rows.odd_documents(spark).repartition(3)
    got = alignment.align(docs).collect()
    want, counts, top = expected([r[:2] for r in llm_rows.odd_rows()])
    assert sorted([tuple(r) for r in got], key=repr) == want
    if size == 200:
        table = {(r["a"], r["b"]): (r["count"], r["best"]) for r in alignment.links(docs).collect()}
        assert table == {p: (n, n == top[p[1]]) for p, n in counts.items()}


def test_empty_table(spark):
    assert alignment.align(llm_rows.no_documents(spark)).collect() == []


def test_token_bytes_are_the_decoders():
    _, one = alignment.byte_level(VOCAB_A)
    decode = ByteLevel().decode
    whole = [i for i in range(0, 50256, 7) if "�" not in decode([TOKENIZER.id_to_token(i)])]
    assert len(whole) > 6000
    assert all(one.tokens[i] == decode([TOKENIZER.id_to_token(i)]).encode() for i in whole)


def test_a_run_of_blanks_that_the_faster_library_gives_up_on():
    text = "a" + " " * 1_200_000 + "b"
    got = alignment.align_texts([text, "c d"], FILES)
    want = alignment.align_texts([text, "c d"], FILES._replace(ranks=None))
    assert got.n_a.tolist() == want.n_a.tolist() and got.groups == want.groups and got.n_a[0] > 1
