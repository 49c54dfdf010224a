"""How the tokens of two vocabularies line up over the same texts.

Both tokenizers cut the same bytes. Byte offsets at which both end a token are
cuts; the tokens between two cuts are a group, and the two tokens that end at a cut are
linked (no token is empty, so there is one of each side). `merge` finds the
cuts in lockstep: one state vector holds the A and B pointers of all texts of a block,
each step compares the ends that they point to, emits cuts and links where they are equal,
moves the pointers, and drops texts that are done. Long texts take part in stretches of
STRETCH bytes, whose pointers start where the stretch does, so that the number of steps
depends on STRETCH and not on the longest text.

How often a pair of ids is linked is counted over all texts. Texts are held in blocks
of about LINKS links. A block lists its distinct pairs once; these rows, some
ten thousand per block, meet the counts of the corpus by pair and come back to the
block, so no row per link is shuffled and a pair, however common, has one row
per block. Each document's own pairs are stored as places in its block's list.

Null and empty texts, and those which a tokenizer does not give back byte for byte (it may
change characters), have no tokens: all figures 0 and no groups. Ids pass through, null
or repeated, each row by itself; an empty table gives no rows. Texts are never cut for
the tokenizers. Other columns of the table are not read, so their names can't clash.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from runlens.llm import vocabulary
from runlens.llm.common import text_of
from runlens.llm.periodic import blocks
from runlens.session import materialize

B = "piece_bpe_32k.model"
#: Bytes of text that are encoded and merged together.
BLOCK = 2 << 20
#: Bytes of a text that one entry of the state vector walks through.
STRETCH = 1024
#: Links after which a block of stored documents is closed; a document counts as DOCUMENT more.
LINKS = 1_000_000
DOCUMENT = 16
BLANK = "▁"


class Side(NamedTuple):
    """A vocabulary: the bytes of each token and their number."""

    tokens: list[bytes]
    sizes: np.ndarray
    digits: np.ndarray


def side(tokens: list[bytes]) -> Side:
    """Also the decimal digits of each id, right-aligned, zero bytes before them and one place after."""
    numbers = np.arange(len(tokens))
    width = len(str(len(tokens)))
    digits = np.zeros((len(tokens), width + 1), dtype=np.uint8)
    for place in range(width):
        power = 10**place
        shown = (numbers >= power) | (place == 0)
        digits[shown, width - 1 - place] = ord("0") + numbers[shown] // power % 10
    return Side(tokens, np.array([len(t) for t in tokens], dtype=np.int64), digits)


@lru_cache(maxsize=2)
def byte_level(content: str) -> tuple[Tokenizer, Side]:
    """A tokenizer of the byte-level kind; special tokens' strings are plain text for it."""
    tokenizer = Tokenizer.from_str(content)
    tokenizer.encode_special_tokens = True
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    if set(chars) != set(ByteLevel.alphabet()):
        raise ValueError("not the byte-level alphabet")
    tokens = []
    for i in range(tokenizer.get_vocab_size()):
        text = tokenizer.id_to_token(i) or ""
        tokens.append(bytes(chars[c] for c in text) if set(text) <= set(chars) else text.encode())
    return tokenizer, side(tokens)


@lru_cache(maxsize=2)
def pieces(content: bytes) -> tuple[sentencepiece.SentencePieceProcessor, Side]:
    """A tokenizer of the piece kind, which puts a blank before the text."""
    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    tokens = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(BLANK, " ").encode()
        for i in range(model.get_piece_size())
    ]
    return model, side(tokens)


def stretches(ends: np.ndarray, starts: np.ndarray, edges: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each edge, a byte of text `row`, the first of the text's tokens that ends after it."""
    base = np.zeros(len(starts) - 1, dtype=np.int64)
    reach = int(max(ends.max(initial=0), edges.max(initial=0))) + 1
    texts = np.repeat(np.arange(len(base)), np.diff(starts))
    return np.searchsorted(ends + texts * reach, edges + row * reach, side="right")


def merge(
    ends_a: np.ndarray, starts_a: np.ndarray, ends_b: np.ndarray, starts_b: np.ndarray, stretch: int = STRETCH
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked A tokens and of their B tokens, in the order of the texts.

    `ends_*` are byte ends inside each text, `starts_*` where the texts start in them. A and B
    cover the same bytes of each text.
    """
    size = np.zeros(len(starts_a) - 1, dtype=np.int64)
    full = np.diff(starts_a) > 0
    size[full] = ends_a[starts_a[1:][full] - 1]
    parts = -(-size // stretch)
    row = np.repeat(np.arange(len(size)), parts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    at_a, at_b = (stretches(e, s, number * stretch, row) for e, s in ((ends_a, starts_a), (ends_b, starts_b)))
    # An entry of the state vector ends where the next stretch of its text starts.
    upto = np.minimum((number + 1) * stretch, size[row])
    stop_a, stop_b = (stretches(e, s, upto, row) for e, s in ((ends_a, starts_a), (ends_b, starts_b)))
    cut_a, cut_b = np.zeros(len(ends_a), dtype=bool), np.zeros(len(ends_b), dtype=bool)
    live = (at_a < stop_a) & (at_b < stop_b)
    at_a, at_b, stop_a, stop_b = (x[live] for x in (at_a, at_b, stop_a, stop_b))
    while len(at_a):
        end_a, end_b = ends_a[at_a], ends_b[at_b]
        both = end_a == end_b
        cut_a[at_a[both]] = True
        cut_b[at_b[both]] = True
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        live = (at_a < stop_a) & (at_b < stop_b)
        if not live.all():
            at_a, at_b, stop_a, stop_b = (x[live] for x in (at_a, at_b, stop_a, stop_b))
    return np.flatnonzero(cut_a), np.flatnonzero(cut_b)


def written(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, sides: tuple[Side, Side]) -> tuple[bytes, np.ndarray]:
    """The groups of all texts as `a1,a2|b1;a3|b2,b3;`, and where each group ends."""
    width = max(s.digits.shape[1] for s in sides)
    stream = np.zeros((len(a) + len(b), width), dtype=np.uint8)
    group_a = np.searchsorted(cut_a, np.arange(len(a)))
    group_b = np.searchsorted(cut_b, np.arange(len(b)))
    # Before an A token stand the B tokens of earlier groups, before a B token also the A tokens of its own.
    before = np.concatenate([[0], cut_b + 1])
    place_a = np.arange(len(a)) + before[group_a]
    place_b = np.arange(len(b)) + cut_a[group_b] + 1 if len(b) else np.empty(0, np.int64)
    for ids, place, s in ((a, place_a, sides[0]), (b, place_b, sides[1])):
        stream[place, width - s.digits.shape[1] :] = s.digits[ids]
    stream[:, -1] = ord(",")
    stream[place_a[cut_a], -1] = ord("|")
    stream[place_b[cut_b], -1] = ord(";")
    shown = stream != 0
    return stream[shown].tobytes(), np.cumsum(shown.sum(1))[place_b[cut_b]]


class Vocabularies(NamedTuple):
    """Contents of files: A, B, and if there is one A's ranks for a faster library."""

    a: str
    b: bytes
    ranks: str | None


def ids_by_ranks(text: str, tokenizer: Tokenizer, ranks: str) -> list[int]:
    """Ids of A by the faster library; it gives up on some very long runs of blanks, which the other one takes."""
    try:
        found = vocabulary.encoding(ranks, vocabulary.PATTERN).encode_to_numpy(
            text, allowed_special=set(), disallowed_special=()
        )
        return found.tolist()
    except ValueError:
        return tokenizer.encode(text, add_special_tokens=False).ids


def encode(texts: list[str | None], files: Vocabularies) -> tuple[list[np.ndarray], tuple[Side, Side]]:
    """Ids of A and B and where each text starts in them; texts that don't come back have none."""
    tokenizer, one = byte_level(files.a)
    model, two = pieces(files.b)
    here = [i for i, t in enumerate(texts) if t]
    if files.ranks is None:
        spaced = [" " + texts[i] for i in here]
        found_a = [e.ids for e in tokenizer.encode_batch_fast(spaced, add_special_tokens=False)]
    else:
        found_a = [ids_by_ranks(" " + texts[i], tokenizer, files.ranks) for i in here]
    found_b = model.encode([texts[i] for i in here], num_threads=1)
    ids: tuple[list, list] = ([], [])
    counts = np.zeros((2, len(texts)), dtype=np.int64)
    for i, a, b in zip(here, found_a, found_b):
        plain = (" " + texts[i]).encode()
        pair = (a, b)
        if all(b"".join(map(s.tokens.__getitem__, x)) == plain for x, s in zip(pair, (one, two))):
            for k in range(2):
                ids[k].append(np.array(pair[k], dtype=np.int64))
                counts[k, i] = len(pair[k])
    starts = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
    flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in ids]
    return [flat[0], starts[0], flat[1], starts[1]], (one, two)


def ends_of(ids: np.ndarray, starts: np.ndarray, s: Side) -> np.ndarray:
    """Byte ends of tokens inside their text."""
    sums = np.concatenate([[0], np.cumsum(s.sizes[ids])])
    return sums[1:] - np.repeat(sums[starts[:-1]], np.diff(starts))


class Aligned(NamedTuple):
    """Alignment of a block of texts."""

    n_a: np.ndarray
    n_b: np.ndarray
    #: Where each text's links start.
    starts: np.ndarray
    a: np.ndarray
    b: np.ndarray
    groups: list[str]


def align_texts(texts: list[str | None], files: Vocabularies, stretch: int = STRETCH) -> Aligned:
    (a, starts_a, b, starts_b), sides = encode(texts, files)
    cut_a, cut_b = merge(ends_of(a, starts_a, sides[0]), starts_a, ends_of(b, starts_b, sides[1]), starts_b, stretch)
    starts = np.searchsorted(cut_a, starts_a)
    text, ends = written(a, b, cut_a, cut_b, sides)
    edges = np.concatenate([[0], ends])[starts]
    groups = [text[x : max(x, y - 1)].decode() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return Aligned(np.diff(starts_a), np.diff(starts_b), starts, a[cut_a], b[cut_b], groups)


class Block:
    """Distinct pairs of the documents stored so far, and how often each is linked."""

    def __init__(self) -> None:
        self.keys = np.empty(0, dtype=np.int64)
        self.counts = np.empty(0, dtype=np.int64)
        self.places: dict[int, int] = {}
        self.size = 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Count pairs and give their places in this block's list."""
        known = self.places
        places = np.array([known.setdefault(k, len(known)) for k in keys.tolist()], dtype=np.int64)
        if len(known) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros(len(known) - len(self.counts), dtype=np.int64)])
        np.add.at(self.counts, places, times)
        return places


def vocabularies(vocab_a: str | None, vocab_b: str | None) -> Vocabularies:
    """Read by the driver; the ranks are used with the vocabulary that they belong to only."""
    return Vocabularies(
        vocabulary.read(vocab_a),
        Path(vocab_b or public_tokenizers.path(B)).read_bytes(),
        vocabulary.read_ranks() if vocab_a is None else None,
    )


def encoded(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    files: Vocabularies,
    shown: Callable[[Column], Column],
) -> DataFrame:
    """Stored rows of two kinds: documents with their pairs as places in the block's list, and the lists.

    `block` names a task and one of its blocks. A row with `pair` is an entry of the list.
    """
    _, one = byte_level(files.a)
    _, two = pieces(files.b)
    if not (one.sizes.all() and two.sizes.all()):
        raise ValueError("a vocabulary has an empty token")
    sent = docs.sparkSession.sparkContext.broadcast(files)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shift = len(two.tokens)
    id_type = pa.null()
    names = ["id", "n_a", "n_b", "n_links", "groups", "places", "times", "block", "place", "a", "b", "n"]
    schema = (
        f"id {kind}, n_a long, n_b long, n_links long, groups string, places array<int>, times array<int>, "
        "block long, place int, a int, b int, n long"
    )

    def entries(block: Block, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        keys = np.fromiter(block.places, dtype=np.int64, count=len(block.places))
        n = len(keys)
        empty = [pa.nulls(n, t) for t in (id_type, *[pa.int64()] * 3, pa.string(), *[pa.list_(pa.int32())] * 2)]
        arrays = [
            pa.array(np.full(n, number)),
            pa.array(np.arange(n, dtype=np.int32)),
            pa.array((keys // shift).astype(np.int32)),
            pa.array((keys % shift).astype(np.int32)),
            pa.array(block.counts),
        ]
        return pa.RecordBatch.from_arrays(empty + arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        number = TaskContext.get().partitionId() << 32
        block = Block()
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for x, y in blocks(sizes, BLOCK):
                found = align_texts(batch.column("text").slice(x, y - x).to_pylist(), sent.value)
                # Distinct pairs of each text, with their numbers.
                text = np.repeat(np.arange(y - x), np.diff(found.starts))
                order = np.lexsort((found.b, found.a, text))
                keys, text = (found.a * shift + found.b)[order], text[order]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                times = np.diff(np.concatenate([first, [len(keys)]]))
                places = block.add(keys[first], times)
                block.size += len(keys) + DOCUMENT * (y - x)
                cuts = pa.array(np.searchsorted(text[first], np.arange(y - x + 1)), pa.int32())
                ids = batch.column("id").slice(x, y - x)
                documents = [
                    ids,
                    pa.array(found.n_a),
                    pa.array(found.n_b),
                    pa.array(np.diff(found.starts)),
                    pa.array(found.groups, pa.string()),
                    pa.ListArray.from_arrays(cuts, pa.array(places, pa.int32())),
                    pa.ListArray.from_arrays(cuts, pa.array(times, pa.int32())),
                    pa.array(np.full(y - x, number)),
                    *[pa.nulls(y - x, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64())],
                ]
                yield pa.RecordBatch.from_arrays(documents, names=names)
                if block.size >= LINKS:
                    yield entries(block, number, ids.type)
                    number, block = number + 1, Block()
                id_type = ids.type
        if block.places:
            yield entries(block, number, id_type)

    return materialize(rows.mapInArrow(run, schema).withColumn("groups", shown(F.col("groups"))), "aligned")


def pair_counts(entries: DataFrame) -> DataFrame:
    """Each linked pair of ids (a, b): its number of links, and whether no pair with the same b has more.

    A `b` has at most as many pairs as A has tokens.
    """
    counts = entries.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = F.max("count").over(Window.partitionBy("b"))
    return counts.withColumn("best", F.col("count") == highest)


def totals(documents: pa.Table, lookup: pa.Table) -> pa.Table:
    """The documents of a block with the sums over their links."""
    count = np.zeros(lookup.num_rows, dtype=np.int64)
    best = np.zeros(lookup.num_rows, dtype=np.int64)
    place = lookup.column("place").to_numpy()
    count[place], best[place] = lookup.column("count").to_numpy(), lookup.column("best").to_numpy()
    places, times = (pc.list_flatten(documents.column(k)).to_numpy() for k in ("places", "times"))
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(documents.column("places")).to_numpy())])
    sums = [np.concatenate([[0], np.cumsum(times * values[places])]) for values in (best, count)]
    n_best, count_sum = (pa.array(np.diff(s[cuts]), pa.int64()) for s in sums)
    kept = [documents.column(k) for k in ("id", "n_a", "n_b", "n_links", "groups")]
    return pa.table([*kept, n_best, count_sum], names=["id", "n_a", "n_b", "n_links", "groups", "n_best", "count_sum"])


def align(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocab_a: str | None = None,
    vocab_b: str | None = None,
    shown: Callable[[Column], Column] = lambda groups: groups,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_links (and groups: as many), groups, n_best, count_sum.

    `groups` reads `a1,a2|b1;a3|b2,b3`, ids in order; it is several times as long as the
    text, and `shown` says what is stored of it. `n_best` counts the links whose pair is the most
    frequent one of its B id in the corpus, `count_sum` adds up the links' corpus counts.
    """
    rows = encoded(docs, id_col, text_col, vocabularies(vocab_a, vocab_b), shown)
    entries = rows.where("place is not null").select("block", "place", "a", "b", "n")
    lookup = entries.join(pair_counts(entries), ["a", "b"]).select(
        F.col("block").alias("in_block"), "place", "count", F.col("best").cast("long").alias("best")
    )
    documents = rows.where("place is null").select("block", "id", "n_a", "n_b", "n_links", "groups", "places", "times")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_links long, groups string, n_best long, count_sum long"
    return documents.groupBy("block").cogroup(lookup.groupBy("in_block")).applyInArrow(totals, schema)


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_a: str | None = None, vocab_b: str | None = None) -> DataFrame:
    """The table of linked ids over all documents: a, b, count, best."""
    rows = encoded(docs, id_col, text_col, vocabularies(vocab_a, vocab_b), lambda groups: F.lit(None).cast("string"))
    return pair_counts(rows.where("place is not null"))
