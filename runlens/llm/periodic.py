"""Periodic runs of words, found by a sparse diagonal DP that goes through a text word by word.

A run is a stretch of words with smallest period q in which at least `times`
periods fit, and that no neighbouring word extends. On the diagonal of lag q
(words q apart) it is an unbroken match. `online` takes the words in order: the
earlier occurrences of a word's end raise the match length of their lag, a
lag that is not raised has ended, and a diagonal that ends long enough gives
its run at once.

All earlier occurrences of all words would be a number of pairs that grows with
the square of the text. `cells` leaves those that can't lie on a run's
diagonal: for lags above L/2 and up to L, only the nearest earlier occurrence of
the last L words counts (L = 1, 2, 4 ...). A run of such a period has four periods, so
each of its places but the first ones ends with L >= q words that occurred q words
earlier, and a nearer occurrence of them would give the run a smaller period (two
periods p, q of q + p words imply their greatest common divisor). So a
word has at most one lag per L, and the strings of L words are numbered by
pairs of numbers of L/2 words; strings without an occurrence within a quarter
of the text leave at each doubling, after which little is left of prose.

Null text counts as empty: no words, no runs, empty collapsed text. Ids pass through,
null or repeated, each row by itself; an empty table gives no rows. A text is
never cut; texts are taken in blocks of about BLOCK bytes, so one very long text is a
block of its own. Other columns of the table are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import text_of

LEAST = 6
TIMES = 4
#: Bytes of text that are worked on together.
BLOCK = 8 << 20

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII blanks, one text after the other, and where each text starts (with the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    words = lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    return (words if full.all() else words.filter(pa.array(full))), before[ends]


def cells(codes: np.ndarray, starts: np.ndarray, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, lag, L): the last L words up to the place occurred `lag` words earlier; by text and place."""
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    stop = starts[1:][text]
    widest = (sizes // times)[text]
    at = np.arange(len(codes))
    key = text * (int(codes.max(initial=0)) + 1) + codes
    number = np.empty(len(codes), dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        ordered, places = key[order], at[order]
        new = ordered[1:] != ordered[:-1]
        apart = np.where(new, len(codes), np.diff(places))
        back, ahead = (np.full(len(at), len(codes)) for _ in range(2))
        back[order[1:]], ahead[order[:-1]] = apart, apart
        names = np.empty(len(at), dtype=np.int64)
        names[order] = np.concatenate([[0], np.cumsum(new)])

        hit = (back > width // 2) & (back <= np.minimum(width, widest[at]))
        found.append((at[hit] + width - 1, back[hit], np.full(int(hit.sum()), width)))

        alive = np.minimum(back, ahead) <= widest[at]
        number.fill(-1)
        number[at[alive]] = names[alive]
        at = at[alive]
        at = at[at + 2 * width <= stop[at]]
        second = number[at + width]
        at, second = at[second >= 0], second[second >= 0]
        key = number[at] * len(codes) + second
        width *= 2
    place, lag, width = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in range(3))
    order = np.lexsort((lag, place))
    return place[order], lag[order], width[order]


def online(
    found: Iterable[tuple[int, int, int]], least: int = LEAST, times: int = TIMES
) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one text, from its cells in the order of places."""
    active: dict[int, int] = {}
    ended: list[tuple[int, int, int]] = []
    raised: dict[int, int] = {}
    now = -1

    def step() -> None:
        """Take the word at `now`: lags that it raised go on, the others have ended."""
        nonlocal active, raised
        for lag, match in active.items():
            if lag not in raised and match + lag >= max(least, times * lag):
                ended.append((now - match - lag, match + lag, lag))
        active, raised = raised, {}

    for place, lag, width in found:
        if place != now:
            step()
            if place > now + 1:
                now += 1
                step()
            now = place
        raised[lag] = active[lag] + 1 if lag in active else width
    for _ in range(2):
        step()
        now += 1
    return sorted(ended)


def runs_of(
    codes: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES
) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a block, by start and period."""
    place, lag, width = cells(codes, starts, times)
    cuts = np.searchsorted(place, starts)
    runs: list[list[tuple[int, int, int]]] = []
    for first, a, b in zip(starts.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
        if a == b:
            runs.append([])
            continue
        runs.append(online(zip((place[a:b] - first).tolist(), lag[a:b].tolist(), width[a:b].tolist()), least, times))
    return runs


def kept_words(runs: list[list[tuple[int, int, int]]], starts: np.ndarray) -> np.ndarray:
    """Which words no run contains after its first period."""
    turn = np.zeros(int(starts[-1]) + 1, dtype=np.int64)
    inside = [(s + start + q, s + start + n) for s, found in zip(starts.tolist(), runs) for start, n, q in found]
    if inside:
        first, last = np.array(inside).T
        np.add.at(turn, first, 1)
        np.add.at(turn, last, -1)
    return np.cumsum(turn[:-1]) == 0


def blocks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes together, at least one row each."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def collapse(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES
) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period) in order, and the collapsed text.

    The collapsed text has the words that no run contains after its first
    period, joined by one space. Rows stay where they are: nothing is shuffled.
    `times` is 3 at least: the sieve of `cells` needs three periods of a run.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for a, b in blocks(sizes, BLOCK):
                part = batch.slice(a, b - a)
                words, starts = split(part.column("text"))
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                runs = runs_of(codes, starts, least, times)
                kept = kept_words(runs, starts)
                before = np.concatenate([[0], np.cumsum(kept)])[starts]
                left = words if kept.all() else words.filter(pa.array(kept))
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(before, pa.int32()), left), " ")
                listed = pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], pa.list_(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(starts)), listed, texts],
                    names=["id", "n_words", "runs", "collapsed"],
                )

    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string")
