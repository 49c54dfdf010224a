"""Token counts with a shortcut for words that are one token.

Offline, every string of the vocabulary is run through the library alone;
those that come back as one pre-token and one token are proven whole. A text is
cut into pre-tokens: proven ones count one, and only the rest is merged.

The cut is made with the vocabulary's own pattern. Whether a character is a
letter, a digit or a blank may differ between two versions of Unicode, so the
pattern is used for characters that were compared with the library
offline; a text with any other character is cut by the library itself. A text
that holds an added token's string goes to the library whole.

Null text counts as empty: 0 bytes, 0 tokens. Ids pass through as they are,
null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runlens.llm import vocabulary
from runlens.llm.common import text_of

LIMIT = 512
#: Characters below this one are compared offline.
COMPARED = 0x3000
#: Merged pre-tokens that a worker remembers; the memory is emptied when it is full.
REMEMBERED = 300_000


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """Strings of the vocabulary that encode, alone, as one pre-token and one token."""
    ids = range(tokenizer.get_vocab_size(with_added_tokens=False))
    added = set(tokenizer.get_added_tokens_decoder())
    strings = [tokenizer.decode([i], skip_special_tokens=False) for i in ids if i not in added]
    strings = [s for s in strings if s and "�" not in s]
    found = tokenizer.encode_batch(strings, add_special_tokens=False)
    cut = regex.compile(vocabulary.PATTERN)
    return frozenset(s for s, e in zip(strings, found) if len(e.ids) == 1 and cut.findall(s) == [s])


def odd_characters(tokenizer: Tokenizer) -> str:
    """Characters below COMPARED that the pattern and the library's own cut treat differently."""
    cut = regex.compile(vocabulary.PATTERN)
    odd = []
    for point in range(COMPARED):
        probe = f"a{chr(point)}1{chr(point)} {chr(point)}{chr(point)}!"
        spans = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(probe)]
        if spans != [m.span() for m in cut.finditer(probe)]:
            odd.append(chr(point))
    return "".join(odd)


class Counter:
    """Counts the tokens of one text after the other."""

    def __init__(self, tokenizer: Tokenizer, whole: frozenset[str], odd: str) -> None:
        self.tokenizer = tokenizer
        self.whole = whole
        self.cut = regex.compile(vocabulary.PATTERN).findall
        strange = "".join(map(regex.escape, odd))
        self.strange = regex.compile(f"[{strange}\\U{COMPARED:08x}-\\U0010ffff]").search
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.merged: dict[str, int] = {}

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not self.strange(text):
            return self.cut(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if any(t in text for t in self.added):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        pieces = self.pieces(text)
        whole, merged = self.whole, self.merged
        rest = [p for p in pieces if p not in whole]
        new = list({p for p in rest if p not in merged})
        if new:
            if len(merged) + len(new) > REMEMBERED:
                merged = self.merged = {}
                new = list(set(rest))
            for piece, found in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
                merged[piece] = len(found.ids)
        return len(pieces) - len(rest) + sum(map(merged.__getitem__, rest))


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, vocab_path: str | None = None
) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    content = vocabulary.read(vocab_path)
    here = vocabulary.tokenizer(content)
    proven = docs.sparkSession.sparkContext.broadcast((content, whole_tokens(here), odd_characters(here)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        content, whole, odd = proven.value
        counter = Counter(vocabulary.tokenizer(content), whole, odd)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col(id_col).alias("id"),
        text_of(text_col).alias("text"),
        F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
