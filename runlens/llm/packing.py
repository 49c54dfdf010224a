"""Packing of documents into sequences of fixed length by minimum bin slack.

A document's ids are cut into full sequences and one remainder. What matters
for packing is only how many remainders have which length: a table of less than
`capacity` numbers. From these counts the next sequence is built round the
longest remainder left: a subset-sum over the lengths, one bit per reachable
sum, finds the fill closest to the capacity, and walking back through the bits
gives how many of each length it takes. The fill is used as often as the counts
allow, so there are few fills however many documents there are.

The n-th remainder of a length then has a fixed place. Remainders are numbered
by input partition, in the task that encodes them, and the partitions' counts
are summed up; no text or id is shuffled for it.

Null text counts as empty: its one id is the end mark. Ids of documents pass
through, null or repeated. A document of n ids gives ceil(n / capacity) pieces.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm import vocabulary
from runlens.llm.common import text_of
from runlens.session import materialize

CAPACITY = 1024
END = 0


class Fill(NamedTuple):
    """One way to fill a sequence: (length, how many) and how many sequences are filled so."""

    members: tuple[tuple[int, int], ...]
    repeats: int


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length sum up closest to `room`; common lengths are preferred."""
    stages: list[tuple[int, int, int]] = []
    reach, mask = 1, (1 << (room + 1)) - 1
    for length in sorted(counts, key=lambda x: (-counts[x], x)):
        left = min(counts[length], room // length)
        if not left:
            continue
        stages.append((length, left, reach))
        step = 1
        while left:
            step = min(step, left)
            reach |= (reach << (length * step)) & mask
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, most, before in reversed(stages):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            used[length] = n
    return used


def fills(counts: dict[int, int], capacity: int) -> list[Fill]:
    """Fills that use up all counts."""
    left = {length: n for length, n in counts.items() if n}
    found: list[Fill] = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        used = closest_fill(rest, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        repeats = min(left[length] // n for length, n in used.items())
        found.append(Fill(tuple(sorted(used.items(), reverse=True)), repeats))
        for length, n in used.items():
            left[length] -= n * repeats
            if not left[length]:
                del left[length]
    return found


class Places:
    """Where the n-th remainder of each length goes."""

    BITS = 48

    def __init__(self, plan: list[Fill], first_sequence: int) -> None:
        taken: dict[int, int] = {}
        rows = []
        sequence = first_sequence
        for fill in plan:
            offset = 0
            for length, n in fill.members:
                start = taken.get(length, 0)
                rows.append(((length << self.BITS) + start, n, offset, sequence))
                taken[length] = start + n * fill.repeats
                offset += length * n
            sequence += fill.repeats
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
        self.keys, self.used, self.offsets, self.sequences = (np.ascontiguousarray(c) for c in table.T)

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of remainders by length and rank."""
        keys = (lengths << self.BITS) + ranks
        at = np.searchsorted(self.keys, keys, side="right") - 1
        within = keys - self.keys[at]
        return self.sequences[at] + within // self.used[at], self.offsets[at] + within % self.used[at] * lengths


def ids_of(text: str, ranks: str, vocab: str) -> np.ndarray:
    """The text's ids without the end mark; both arguments are contents of files of the same vocabulary."""
    try:
        return vocabulary.encoding(ranks, vocabulary.PATTERN).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # its pattern backtracks over runs of blanks and gives up on long ones
        return np.array(vocabulary.tokenizer(vocab).encode(text, add_special_tokens=False).ids)


def encode(
    docs: DataFrame, id_col: str, text_col: str, capacity: int, ranks_path: str | None, keep_ids: bool, vocab_path: str | None = None
) -> DataFrame:
    """One stored row per document: ids cut at `capacity`, and its numbers inside the input partition.

    `rest` is the remainder's length, `rank` its number among remainders of
    that length, `full_before` the number of full pieces before this document.
    """
    files = docs.sparkSession.sparkContext.broadcast((vocabulary.read_ranks(ranks_path), vocabulary.read(vocab_path)))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    fields = ["id", "tokens", "crcs", "rest", "part", "rank", "full_before"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, vocab = files.value
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity, dtype=np.int64)
        full = 0
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            kept: list[bytes] = []
            for text in batch.column(1).to_pylist():
                data = ids_of(text, ranks, vocab).astype("<u4").tobytes() + end
                n = len(data) // 4
                rest = n % capacity
                cuts = range(0, len(data), 4 * capacity)
                values = (n, [zlib.crc32(data[c : c + 4 * capacity]) for c in cuts], rest, part, seen[rest], full)
                for column, value in zip(out, values):
                    column.append(value)
                seen[rest] += 1
                full += n // capacity
                if keep_ids:
                    kept.append(data)
            types = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(out, types))]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * keep_ids, names=fields)

    schema = f"id {kind}, tokens long, crcs array<long>, rest long, part long, rank long, full_before long"
    return materialize(rows.mapInArrow(run, schema + ", ids binary" * keep_ids), "encoded")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    ranks_path: str | None = None,
    keep_ids: bool = False,
    vocab_path: str | None = None,
) -> DataFrame:
    """One row per piece: id, start, length, crc, tokens, sequence, offset.

    `ranks_path` and `vocab_path` name the two files of the same vocabulary.
    With `keep_ids` also the piece's `ids` as unsigned 32-bit numbers, little-endian.
    """
    encoded = encode(docs, id_col, text_col, capacity, ranks_path, keep_ids, vocab_path)
    # At most `capacity` rows: the counts that the fills are made from.
    counts = encoded.groupBy("rest").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("tokens") / capacity)).cast("long").alias("full")
    ).collect()
    plan = fills({r["rest"]: r["n"] for r in counts if r["rest"]}, capacity)
    places = docs.sparkSession.sparkContext.broadcast(Places(plan, sum(r["full"] for r in counts)))

    sizes = encoded.groupBy("part", "rest").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("tokens") / capacity)).cast("long").alias("full")
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sizes.select("part", "rest", F.coalesce(F.sum("n").over(earlier.partitionBy("rest")), F.lit(0)).alias("rank_start"))
    fulls = sizes.groupBy("part").agg(F.sum("full").alias("full")).select(
        "part", F.coalesce(F.sum("full").over(earlier), F.lit(0)).alias("full_start")
    )
    kind = encoded.schema["id"].dataType.simpleString()
    numbered = encoded.join(ranks.join(fulls, "part"), ["part", "rest"]).select(
        "id",
        "tokens",
        "crcs",
        "rest",
        (F.col("rank") + F.col("rank_start")).alias("rank"),
        (F.col("full_before") + F.col("full_start")).alias("first"),
        *["ids"] * keep_ids,
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, rest, rank, first = (batch.column(k).to_numpy() for k in ("tokens", "rest", "rank", "first"))
            pieces = -(-tokens // capacity)
            row = np.repeat(np.arange(len(tokens)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            length = np.minimum(tokens[row] - start, capacity)
            sequence, offset = first[row] + number, np.zeros(len(row), dtype=np.int64)
            part = length < capacity
            if part.any():
                sequence[part], offset[part] = places.value.find(rest[row][part], rank[row][part])
            arrays = [
                batch.column("id").take(pa.array(row)),
                *map(pa.array, (start, length)),
                batch.column("crcs").flatten(),
                *map(pa.array, (tokens[row], sequence, offset)),
            ]
            if keep_ids:
                ids = batch.column("ids").to_pylist()
                cut = zip(row.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist())
                arrays.append(pa.array([ids[r][a:b] for r, a, b in cut], pa.binary()))
            names = ["id", "start", "length", "crc", "tokens", "sequence", "offset"] + ["ids"] * keep_ids
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"id {kind}, start long, length long, crc long, tokens long, sequence long, offset long"
    return numbered.mapInArrow(place, schema + ", ids binary" * keep_ids)
