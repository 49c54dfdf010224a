"""Languages of texts and of spans inside mixed texts.

A text is cut into words where its script changes or no letter follows. The script of a word
narrows its candidates to the languages that use this script; each
candidate gets a score from the word's strings of 1 to 4 characters and the word itself.
Viterbi then finds the labels with the greatest sum of scores, less a penalty for
each change of language, so that a stray word does not part a span. The
words of all texts of a block take their steps together, text by text in one row of the state.

Scores are log ratios of smoothed counts in hashed buckets. The counts come from
about SAMPLE labelled documents per language (chosen by a hash of their ids) and the LANGUAGES most
frequent labels: documented bounds of the model, whose size they fix. Shares of
labels, all texts to be labelled and all their characters are whole.

Rows without a label teach nothing. Null text counts as empty; a text without a letter is
`und` with score 0 and no spans, as is every text if nothing was learned. Letters of
scripts that no learned language uses say nothing: such a text gets the most
frequent language with score 0. Ties go to the language that comes first in order. Ids pass through,
null or repeated, each row by itself; an empty table gives no rows. Other columns of
the table are not read, so their names can't clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import text_of
from runlens.llm.periodic import blocks

UNKNOWN = "und"
SAMPLE = 5_000
LANGUAGES = 1_000
SEED = 17
#: Buckets of features, fewer if buckets x languages would be more than CELLS.
BUCKETS = 1 << 17
CELLS = 1 << 22
SMOOTHING = 0.5
#: Occurrences in the sample that a feature needs to say something.
LEAST_COUNT = 2
#: A language uses a script if this share of its sampled letters is written in it.
LEAST_SHARE = 0.001
#: How much one word can say against a language, and what a change of language costs.
MOST_PER_WORD = 6.0
SWITCH = 12.0
#: Score of a language that does not use the word's script.
FAR = -30.0
ORDERS = 4
#: Letters after which a word is cut (scripts without blanks give long ones).
WORD = 16
#: Bytes of text whose words are labelled together, and features x languages scored at once.
BLOCK = 3 << 20
SCORED = 4 << 20

# Blocks of the published character standard, by script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x300, 0x36F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Oriya": [(0xB00, 0xB7F)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Sinhala": [(0xD80, 0xDFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Lao": [(0xE80, 0xEFF)],
    "Tibetan": [(0xF00, 0xFFF)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Mongolian": [(0x1800, 0x18AF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
#: Class 0 is no letter, the last one letters of all other scripts.
OTHER = len(SCRIPTS) + 1
#: No letter has a code above.
POINTS = 0x32400


class Letters(NamedTuple):
    """By code point: the script's class, whether it is a letter, its small letter."""

    script: np.ndarray
    letter: np.ndarray
    small: np.ndarray


@lru_cache(maxsize=1)
def letters() -> Letters:
    script = np.zeros(POINTS + 1, dtype=np.uint8)
    letter = np.zeros(POINTS + 1, dtype=bool)
    small = np.arange(POINTS + 1, dtype=np.uint32)
    for point in range(POINTS):
        char = chr(point)
        letter[point] = char.isalpha()
        lower = char.lower()
        if len(lower) == 1:
            small[point] = ord(lower)
    script[letter] = OTHER
    for place, spans in enumerate(SCRIPTS.values()):
        for first, last in spans:
            marks = [p for p in range(first, last + 1) if letter[p] or unicodedata.category(chr(p)) in ("Mn", "Mc")]
            script[marks] = place + 1
    return Letters(script, letter, small)


class Words(NamedTuple):
    """Words of a block of texts, one text after the other."""

    #: Small letters of the block, and where each word starts and ends in them.
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    #: Letters of each word (marks apart).
    size: np.ndarray
    #: Where each text starts: in the words, and in the characters.
    texts: np.ndarray
    chars: np.ndarray


def cut(texts: list[str]) -> Words:
    known = letters()
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    points = np.minimum(np.frombuffer(joined, dtype=np.uint32), POINTS)
    chars = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    script = known.script[points]
    fresh = np.ones(len(points) + 1, dtype=bool)
    fresh[1:-1] = script[1:] != script[:-1]
    fresh[chars] = True
    edges = np.flatnonzero(fresh)
    # Stretches of one script are cut every WORD letters.
    start, end = edges[:-1], edges[1:]
    of_letters = script[start] > 0 if len(start) else np.zeros(0, dtype=bool)
    start, end = start[of_letters], end[of_letters]
    parts = -(-(end - start) // WORD)
    row = np.repeat(np.arange(len(start)), parts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    start, end = start[row] + number * WORD, np.minimum(start[row] + (number + 1) * WORD, end[row])
    counted = np.concatenate([[0], np.cumsum(known.letter[points])])
    size = counted[end] - counted[start]
    kept = size > 0
    start, end, size = start[kept], end[kept], size[kept]
    return Words(known.small[points], start, end, script[start].astype(np.int64), size, np.searchsorted(start, chars), chars)


def features(words: Words, first: int, last: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of words first ... last-1, and the word of each (from 0)."""
    start, size = words.start[first:last], words.end[first:last] - words.start[first:last]
    # Each word with a blank at both sides.
    width = size + 2
    edge = np.cumsum(width) - width
    word = np.repeat(np.arange(len(size)), width)
    within = np.arange(len(word)) - edge[word]
    inner = (within > 0) & (within <= size[word])
    points = np.full(len(word), 32, dtype=np.uint64)
    points[inner] = words.points[(start[word] + within - 1)[inner]]
    left = width[word] - within
    found, of = [], []
    mixed = np.zeros(len(word), dtype=np.uint64)
    for order in range(1, ORDERS + 1):
        # One more character at the right; a place without room for it has no such string.
        mixed = mixed[: len(word) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + points[order - 1 :] + np.uint64(order)
        fits = left[: len(mixed)] >= order
        if order == 1:
            fits = fits & inner
        found.append(mixed[fits])
        of.append(word[: len(mixed)][fits])
    power = np.uint64(0xD6E8FEB86659FD93) ** np.arange(1, WORD + 3, dtype=np.uint64)
    if len(edge):
        found.append(np.add.reduceat(points * power[within], edge) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(7))
        of.append(np.arange(len(size)))
    values = np.concatenate(found)
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(32)
    return (values & np.uint64(buckets - 1)).astype(np.int64), np.concatenate(of)


class Model(NamedTuple):
    """What was learned; without languages nothing was."""

    languages: list[str]
    #: Log shares of the labels.
    prior: np.ndarray
    #: Score of a feature for each language.
    table: np.ndarray
    #: Which language uses which class of scripts.
    used: np.ndarray


def chunks(words: Words, languages: int) -> Iterator[tuple[int, int]]:
    """Ranges of words whose features are scored together."""
    most = max(1, SCORED // max(1, languages) // (ORDERS + 1))
    yield from blocks(words.end - words.start + 2, most)


def scores(words: Words, model: Model) -> np.ndarray:
    """Of each word for each language: 0 for the best candidate, less for the others."""
    n = len(model.languages)
    out = np.zeros((len(words.start), n), dtype=np.float32)
    for first, last in chunks(words, n):
        bucket, word = features(words, first, last, len(model.table))
        for k in range(n):
            out[first:last, k] = np.bincount(word, weights=model.table[bucket, k], minlength=last - first)
    out /= ORDERS
    used = model.used[words.script]
    out[~used] = -np.inf
    some = used.any(1)
    out[some] = np.maximum(out[some] - out[some].max(1, keepdims=True), -MOST_PER_WORD)
    out[~used] = FAR
    out[~some] = 0.0
    return out


def viterbi(score: np.ndarray, texts: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word: the greatest sum of scores and of the first label's prior, less `switch` per change.

    Texts are ordered by their number of words, so those that still have a
    word at a step are the first ones.
    """
    sizes = np.diff(texts)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = texts[:-1][order], sizes[order]
    # How many texts have more than t words.
    live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes.max(initial=0)), side="right")
    came = np.zeros(len(score), dtype=np.int32)
    changed = np.zeros(score.shape, dtype=bool)
    state = np.tile(prior, (len(sizes), 1))
    for t, n in enumerate(live.tolist()):
        at = first[:n] + t
        now = state[:n]
        if t:
            best = now.argmax(1)
            came[at] = best
            jump = now[np.arange(n), best] - switch
            better = jump[:, None] > now
            changed[at] = better
            now = np.where(better, jump[:, None], now)
        state[:n] = now + score[at]
    label = np.zeros(len(score), dtype=np.int64)
    last = state.argmax(1) if len(state) else np.zeros(0, dtype=np.int64)
    for t in range(len(live) - 1, -1, -1):
        at = first[: live[t]] + t
        here = last[: live[t]]
        label[at] = here
        last[: live[t]] = np.where(changed[at, here], came[at], here)
    return label


class Labels(NamedTuple):
    """Per text: language or None, score, and spans (start, end, language) in characters."""

    language: list[str]
    score: list[float]
    spans: list[list[tuple[int, int, str]]]


def label_texts(texts: list[str], model: Model) -> Labels:
    words = cut(texts)
    n = len(model.languages)
    out = Labels([], [], [])
    if not n:
        return Labels([UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts])
    label = viterbi(scores(words, model), words.texts, model.prior)
    text = np.repeat(np.arange(len(texts)), np.diff(words.texts))
    known = model.used[words.script].any(1)
    weights = np.bincount(text * n + label, weights=words.size * known, minlength=n * len(texts)).reshape(-1, n)
    letters_all = np.bincount(text, weights=words.size, minlength=len(texts))
    # A span starts at the first word with its label, the first one with the text.
    new = np.ones(len(label), dtype=bool)
    new[1:] = (label[1:] != label[:-1]) | (text[1:] != text[:-1])
    opens = np.flatnonzero(new)
    cuts = np.searchsorted(text[opens], np.arange(len(texts) + 1))
    starts, labels = (words.start[opens] - words.chars[text[opens]]).tolist(), label[opens].tolist()
    for i, body in enumerate(texts):
        a, b = int(cuts[i]), int(cuts[i + 1])
        if a == b:
            out.language.append(UNKNOWN)
            out.score.append(0.0)
            out.spans.append([])
            continue
        top = int(weights[i].argmax())
        if not weights[i, top]:
            top = labels[a]
        out.language.append(model.languages[top])
        out.score.append(float(weights[i, top] / letters_all[i]))
        begins = [0, *starts[a + 1 : b]]
        ends = [*begins[1:], len(body)]
        out.spans.append([(x, y, model.languages[k]) for x, y, k in zip(begins, ends, labels[a:b])])
    return out


def learn(counts: np.ndarray, letters_by_script: np.ndarray, languages: list[str], shares: np.ndarray) -> Model:
    """From counts of (feature, language) and of letters by (class, language)."""
    if not languages:
        return Model([], np.empty(0), np.empty((0, 0)), np.zeros((OTHER + 1, 0), dtype=bool))
    smooth = np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * len(counts))
    table = smooth - smooth.mean(1, keepdims=True)
    table[counts.sum(1) < LEAST_COUNT] = 0.0
    used = letters_by_script >= LEAST_SHARE * np.maximum(letters_by_script.sum(0), 1)
    used &= letters_by_script > 0
    return Model(languages, np.log(shares / shares.sum()), table.astype(np.float32), used)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", where: Column | None = None) -> Model:
    """Learn from the labelled rows (`where` says which may be used)."""
    rows = docs.where(F.col(lang_col).isNotNull() & (F.lit(True) if where is None else where))
    found = rows.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in found)
    sizes = {r["lang"]: r["count"] for r in found}
    if not languages:
        return learn(np.empty((0, 0)), np.empty((0, 0)), [], np.empty(0))
    buckets = min(BUCKETS, 1 << (CELLS // len(languages)).bit_length() - 1)
    # At most LANGUAGES rows.
    chosen = docs.sparkSession.createDataFrame(
        [(lang, i, min(1.0, SAMPLE / sizes[lang]) * (1 << 30)) for i, lang in enumerate(languages)],
        "learned string, place int, upto double",
    )
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 30))
    sample = rows.join(F.broadcast(chosen), F.col(lang_col) == F.col("learned")).where(drawn < F.col("upto"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), buckets + OTHER + 1), dtype=np.int64)
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            places = batch.column("place").to_numpy()
            for a, b in blocks(sizes, BLOCK):
                words = cut(batch.column("text").slice(a, b - a).to_pylist())
                lang = np.repeat(places[a:b], np.diff(words.texts)).astype(np.int64)
                np.add.at(counts, (lang, buckets + words.script), words.size)
                for first, last in chunks(words, 1):
                    bucket, word = features(words, first, last, buckets)
                    at = lang[first:last][word] * counts.shape[1] + bucket
                    counts += np.bincount(at, minlength=counts.size).reshape(counts.shape)
        place, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(place.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(counts[place, bucket])],
            names=["place", "bucket", "n"],
        )

    counted = sample.select("place", text_of(text_col).alias("text")).mapInArrow(count, "place int, bucket int, n long")
    # At most CELLS rows and those of the scripts.
    table = counted.groupBy("place", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place, bucket, n = (table.column(k).to_numpy() for k in ("place", "bucket", "n"))
    counts = np.zeros((buckets + OTHER + 1, len(languages)), dtype=np.float64)
    counts[bucket, place] = n
    return learn(counts[:buckets], counts[buckets:], languages, np.array([sizes[k] for k in languages], dtype=np.float64))


SPAN = "struct<start: bigint, end: bigint, lang: string>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])


def label(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang, score (share of its letters in spans of `lang`), spans.

    Spans part the whole text, in code points: start, end (exclusive), lang.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
            for a, b in blocks(sizes, BLOCK):
                part = batch.slice(a, b - a)
                found = label_texts(part.column("text").to_pylist(), sent.value)
                spans = [[dict(zip(("start", "end", "lang"), s)) for s in x] for x in found.spans]
                arrays = [part.column("id"), pa.array(found.language), pa.array(found.score, pa.float64()), pa.array(spans, pa.list_(_SPAN))]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "lang", "score", "spans"])

    return rows.mapInArrow(run, f"id {kind}, lang string, score double, spans array<{SPAN}>")
