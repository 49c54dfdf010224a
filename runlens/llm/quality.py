"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is a grade 0, 1 ... g. One score, the sum of weights shared by all
grades over a document's hashed text features, is compared with ordered
thresholds: P(grade <= k) = sigmoid(threshold k - score). That gives the
expected grade and the tail probability that the grade is at least `least`.

Features are the distinct words, word beginnings and marks of the whole text, and
steps of its shape (capitals, repetition, symbols, lengths). Each is scaled by the
log ratio of its smoothed counts in documents that reach `least` and in others;
features of fewer than LEAST_DOCUMENTS rated documents get none.

The weights are fitted on at most SAMPLE rated documents (those whose ids have the
smallest hashes) and, of these, the first ones that have FEATURES features together: documented
bounds, since the model has a fixed size. One task of an executor fits; the driver
gets the weights alone. Everything else runs over all rows.

Null text counts as empty and is scored by its shape. Ratings that are null, or whose
document is missing, are left out; a document rated twice takes its lowest
grade, and an id with several texts the one whose features come first. If the ratings hold less than two grades nothing can be learned and every
document is kept. Ids pass through, null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import text_of

SAMPLE = 10_000
FEATURES = 1 << 24
BUCKETS = 1 << 18
LEAST_DOCUMENTS = 10
SMOOTHING = 4.0
PENALTY = 0.02
ROUNDS = 200
RATE = 0.02
LEAST_TAIL = 0.5
SEED = 11
#: Documents that are worked on together while fitting.
PART = 1000
#: Features whose places a worker remembers; the memory is emptied when it is full.
REMEMBERED = 500_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = frozenset(b for b in range(256) if b >= 128 or chr(b).isalnum())
WORDS = bytes(_LOWER[b] if b in _WORD else 32 for b in range(256))
MARKS = bytes(32 if b in _WORD else b for b in range(256))
PLAIN = bytes(b for b in range(256) if b in _WORD or b <= 32 or chr(b) in ".,;:'\\\"()?-")
SHARES = (0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


class Places(dict):
    """The bucket of a feature, found when first asked for."""

    def __missing__(self, feature: bytes) -> int:
        place = self[feature] = xxhash.xxh64_intdigest(feature) & (BUCKETS - 1)
        return place


def steps(name: bytes, value: float, cuts) -> list[bytes]:
    return [b"\0%s%d" % (name, i) for i, cut in enumerate(cuts) if value > cut]


def features(text: str, places: Places) -> np.ndarray:
    """The buckets of a whole text's features, sorted and distinct."""
    data = text.encode()
    words = data.translate(WORDS).split()
    distinct = set(words)
    n = max(1, len(words))
    marks = {m for m in data.translate(MARKS).split() if 1 < len(m) < 9}
    shape = steps(b"upper", sum(map(bytes.isupper, data.split())) / n, SHARES)
    shape += steps(b"again", sum(map(operator.eq, words, words[1:])) / n, SHARES)
    shape += steps(b"repeated", 1 - len(distinct) / n, SHARES)
    shape += steps(b"symbols", len(data.translate(None, PLAIN)) / n, SHARES)
    shape += steps(b"marks", len(marks), (0, 2, 4, 8))
    shape += steps(b"length", float(np.log2(n)), range(1, 16))
    shape += steps(b"word", sum(map(len, words)) / n, range(2, 16))
    starts = {w[:4] for w in distinct} | {w[:5] for w in distinct if len(w) > 4}
    if len(places) > REMEMBERED:
        places.clear()
    found = [places[w] for w in distinct]
    found += [places[b"\0start" + s] for s in starts]
    found += [places[b"\0mark" + m] for m in marks]
    found += [places[s] for s in shape]
    return np.unique(np.array(found, dtype=np.int32))


class Model(NamedTuple):
    """Weights by bucket and the ordered thresholds; without thresholds nothing was learned."""

    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum())

    def at_least(self, score: float) -> np.ndarray:
        """P(grade >= k) for k = 1 ... g."""
        return 1 - sigmoid(self.thresholds - score)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def scales(lists: list[np.ndarray], good: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket's smoothed share of good and of other documents."""
    counts = [
        np.bincount(np.concatenate([f for f, g in zip(lists, good) if g == side] or [np.empty(0, np.int32)]), minlength=BUCKETS)
        for side in (True, False)
    ]
    sizes = [int((good == side).sum()) for side in (True, False)]
    shares = [np.log((c + SMOOTHING) / (n + 2 * SMOOTHING)) for c, n in zip(counts, sizes)]
    return np.where(counts[0] + counts[1] >= LEAST_DOCUMENTS, shares[0] - shares[1], 0.0)


def fit(lists: list[np.ndarray], grades: np.ndarray, least: int) -> Model:
    """Minimise the mean negative log likelihood with a penalty on the weights (Adam over the whole sample)."""
    top = int(grades.max()) if len(grades) else 0
    if len(np.unique(grades)) < 2:
        return Model(np.zeros(BUCKETS), np.empty(0))
    scale = scales(lists, grades >= min(least, top))
    # Only buckets with a scale can have a weight.
    used = np.nonzero(scale)[0]
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    slot[used] = np.arange(len(used))
    value = scale[used].astype(np.float32)
    n, m = len(lists), len(used)
    # Documents come in parts, so that a round needs little memory beside the features themselves.
    parts = []
    for first in range(0, n, PART):
        found = [slot[f][slot[f] >= 0] for f in lists[first : first + PART]]
        row = np.repeat(np.arange(first, first + len(found), dtype=np.int32), [len(f) for f in found])
        parts.append((row, np.concatenate(found)))

    # Thresholds as the first one and the logarithms of the gaps, which keeps them in order.
    state = np.concatenate([np.zeros(m), [-1.0], np.zeros(top - 1)])
    mean, square = np.zeros_like(state), np.zeros_like(state)

    def thresholds() -> np.ndarray:
        return state[m] + np.concatenate([[0.0], np.cumsum(np.exp(state[m + 1 :]))])

    for turn in range(1, ROUNDS + 1):
        scaled = state[:m] * value
        score = sum(np.bincount(row, weights=scaled[at], minlength=n) for row, at in parts)
        cuts = np.concatenate([[-np.inf], thresholds(), [np.inf]])
        upper, lower = sigmoid(cuts[grades + 1] - score), sigmoid(cuts[grades] - score)
        upper[grades == top], lower[grades == 0] = 1.0, 0.0
        likely = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = upper * (1 - upper) / likely, lower * (1 - lower) / likely
        by_score = (d_upper - d_lower) / n
        by_weight = sum(np.bincount(at, weights=by_score[row], minlength=m) for row, at in parts) * value
        by_weight += PENALTY * state[:m]
        by_cut = np.zeros(top)
        np.add.at(by_cut, grades[grades < top], -d_upper[grades < top] / n)
        np.add.at(by_cut, grades[grades > 0] - 1, d_lower[grades > 0] / n)
        tails = np.cumsum(by_cut[::-1])[::-1]
        slope = np.concatenate([by_weight, [tails[0]], tails[1:] * np.exp(state[m + 1 :])])
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        state -= RATE * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = state[:m] * scale[used]
    return Model(weights, thresholds())


def train(docs: DataFrame, ratings: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most SAMPLE documents of `ratings` (id, grade), in one task."""
    drawn = F.xxhash64("rated", F.lit(SEED)).alias("turn")
    picked = (
        ratings.select(F.col(id_col).alias("rated"), F.col("grade").cast("int").alias("grade"))
        .where("rated is not null and grade >= 0")
        .groupBy("rated")
        .agg(F.min("grade").alias("grade"))
        .select(drawn, "rated", "grade")
        .orderBy("turn", "rated")
        .limit(SAMPLE)
    )
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # At most SAMPLE ids are broadcast.
    sample = rows.join(F.broadcast(picked), F.col("id") == F.col("rated")).select("turn", "rated", "grade", "text")
    kind = sample.schema["rated"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            found = [features(t, places).tobytes() for t in batch.column("text").to_pylist()]
            kept = [batch.column(k) for k in ("turn", "rated", "grade")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary())], names=["turn", "rated", "grade", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: list[np.ndarray] = []
        grades: list[int] = []
        left = FEATURES
        for batch in batches:
            for grade, data in zip(batch.column("grade").to_pylist(), batch.column("places").to_pylist()):
                left -= len(data) // 4
                if left < 0:
                    break
                lists.append(np.frombuffer(data, np.int32))
                grades.append(grade)
        model = fit(lists, np.array(grades, dtype=np.int64), least)
        arrays = [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.thresholds.tolist()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(arrays, names=["weights", "thresholds"])

    found = sample.mapInArrow(run, f"turn long, rated {kind}, grade int, places binary")
    single = found.groupBy("turn", "rated").agg(F.min("grade").alias("grade"), F.min("places").alias("places"))
    fitted = (
        single.repartition(1)
        .sortWithinPartitions("turn", "rated")
        .select("grade", "places")
        .mapInArrow(learn, "weights binary, thresholds array<double>")
        .first()
    )
    if fitted is None:
        return Model(np.zeros(BUCKETS), np.empty(0))
    return Model(np.frombuffer(bytes(fitted["weights"]), np.float64), np.array(fitted["thresholds"], dtype=np.float64))


def judge(model: Model, least: int, least_tail: float) -> Callable[[str, Places], tuple[float, float, float, bool]]:
    """(score, expected grade, tail probability, kept) of a text."""

    def one(text: str, places: Places) -> tuple[float, float, float, bool]:
        if not len(model.thresholds):
            return 0.0, 0.0, 1.0, True
        score = model.score(features(text, places))
        above = model.at_least(score)
        tail = float(above[min(least, len(above)) - 1])
        return score, float(above.sum()), tail, tail >= least_tail

    return one


def rate(
    docs: DataFrame, model: Model, least: int, least_tail: float = LEAST_TAIL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, score, expected_grade, tail, kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    types = (pa.float64(), pa.float64(), pa.float64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, one = Places(), judge(sent.value, least, least_tail)
        for batch in batches:
            found = [one(t, places) for t in batch.column("text").to_pylist()]
            columns = zip(*found) if found else [()] * 4
            arrays = [batch.column("id"), *(pa.array(list(c), t) for c, t in zip(columns, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "score", "expected_grade", "tail", "kept"])

    return rows.mapInArrow(run, f"id {kind}, score double, expected_grade double, tail double, kept boolean")


def keep_good(docs: DataFrame, model: Model, least: int, least_tail: float = LEAST_TAIL, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns; no row is moved."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, one = Places(), judge(sent.value, least, least_tail)
        for batch in batches:
            kept = [one(t or "", places)[3] for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the labels: 2 for good and clean text, 1 with one flaw, 0 with both."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).alias("grade"))


#: The grade that `graded` gives to good and clean text.
GOOD = 2
