"""Scan for secrets: three base patterns, and strings that don't compress.

The base patterns give spans of the kinds assign, access and hex. Beyond them,
a candidate is a string near a sensitive word, before or after it: any value of
8 characters or more that is quoted or assigned, or else 16 characters or more
with a digit and a letter. Its marginal cost is what
zstandard needs for it on top of its surroundings: the line up to the candidate
is compressed with and without it, with the code around and a list of common
identifiers as dictionary. Names, paths and words built from what the
dictionary holds add few bytes; a random key adds nearly its whole entropy. Candidates
at MARGINAL bytes per character or more are reported as the kind novel, unless
a base span covers them in part.

Spans are code points, the end exclusive. Null text counts as empty: no spans.
Whole texts are scanned whatever their length; only a candidate's surroundings
are limited to AROUND characters, which is a parameter of the measure. Ids
pass through, null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import text_of

#: Fixed values of the base scan: kinds in the order of ties, patterns and least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
ASSIGN_LENGTH = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Words that make what follows sensitive, and how far they reach.
CONTEXT = re.compile(
    r"password|passwd|passphrase|pwd|secret|token|credential|private|api_?key|access_?key|auth|bearer", re.I | re.A
)
CONTEXT_WORDS = (
    b"passw", b"passphrase", b"pwd", b"secret", b"token", b"credential", b"private", b"api", b"access", b"auth", b"bearer"
)
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Values, without the signs that assign them, and what stands before a quoted or assigned one.
VALUE = re.compile(r"[A-Za-z0-9+/_-]{8,}={0,2}")
BARE_LENGTH = 16
MARK = re.compile(r"""(["'`]|[:=]>?\x20*|\b(bearer|basic)\x20+)\Z""", re.I | re.A)
AROUND = 512
#: Pieces of a candidate from this length on are copies of it wherever they stand in its surroundings.
COPY = 8
MARGINAL = 0.55
#: Common identifiers of code and configuration, the second half of the dictionary.
IDENTIFIERS = (
    "access account admin api application auth authorization backend base64 bearer bucket builder button callback "
    "certificate channel class client cluster collection column config configuration connection constructor container "
    "content context controller cookie count create credential database default delete describe directory document "
    "domain element encoding endpoint environment error event example exception export factory false field filename "
    "function handler header host http https identifier import index instance integer interface internal json label "
    "language length library listener local location logger manager message method module name namespace network node "
    "null number object option order output package parameter parent password path pattern payload policy port prefix "
    "private property protected provider public query queue reader reference region register repository request resource "
    "response result return role route runtime schema secret security select sequence server service session setting "
    "signature source static status storage stream string struct table target template test thread time timeout token "
    "transaction true type undefined update upload user username utils value variable vector version view void worker "
    "writer 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
).encode()

Span = tuple[str, int, int]


def base_spans(text: str, lower: bytes) -> list[Span]:
    found: list[Span] = []
    if any(word in lower for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def without_copies(part: str, candidate: str) -> list[str]:
    """The characters of `part`, those of copies of `candidate` or of pieces of COPY characters empty."""
    piece = min(COPY, len(candidate))
    pieces = {candidate[i : i + piece] for i in range(len(candidate) - piece + 1)}
    kept, until = list(part), 0
    for i in range(len(part) - piece + 1):
        if part[i : i + piece] in pieces:
            start, until = max(i, until), i + piece
            kept[start:until] = [""] * (until - start)
    return kept


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """AROUND characters before and after text[start:end], without its copies, also those that reach over the edge."""
    candidate = text[start:end]
    over = min(COPY, len(candidate)) - 1
    low = max(0, start - AROUND)
    more = max(0, low - over)
    before = without_copies(text[more:start], candidate)[low - more :]
    after = without_copies(text[end : end + AROUND + over], candidate)[:AROUND]
    return "".join(before), "".join(after)


def marginal_bytes(before: str, candidate: str, after: str) -> int:
    """What `candidate` adds to the compressed size of its line, given code around it and common identifiers."""
    around = (before + " " + after).encode()
    dictionary = zstandard.ZstdCompressionDict(IDENTIFIERS + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(
        level=6, dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False
    )
    line = before[-REACH:].encode()
    return len(compressor.compress(line + candidate.encode())) - len(compressor.compress(line))


def novel_spans(text: str, lower: bytes, taken: list[Span], marginal: float) -> list[Span]:
    if not any(word in lower for word in CONTEXT_WORDS):
        return []
    found: list[Span] = []
    for word in CONTEXT.finditer(text):
        for m in CANDIDATE.finditer(text, word.end(), word.end() + REACH + AROUND):
            start, end = m.span()
            if start > word.end() + REACH:
                break
            if end == word.end() + REACH + AROUND:  # longer than the window: take the whole run
                end = CANDIDATE.match(text, start).end()
            candidate = text[start:end]
            mixed = any(c.isdigit() for c in candidate) and any(c.isalpha() for c in candidate)
            if not mixed or ("novel", start, end) in found:
                continue
            if any(a < end and start < b for _, a, b in taken):
                continue
            before, after = surroundings(text, start, end)
            cost = marginal_bytes(before, candidate, after)
            if cost >= marginal * len(candidate):
                found.append(("novel", start, end))
    return found + values(text, taken + found, marginal)


def values(text: str, taken: list[Span], marginal: float) -> list[Span]:
    """Novel values on either side of a sensitive word that `taken` doesn't cover in part."""
    words = [m.span() for m in CONTEXT.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]

    def near(places: list[int], low: int, high: int) -> bool:
        at = bisect_left(places, low)
        return at < len(places) and places[at] <= high

    found: list[Span] = []
    for m in VALUE.finditer(text):
        start, end = m.span()
        if not near(ends, start - REACH, start) and not near(starts, end, end + REACH):
            continue
        candidate = m.group()
        mixed = any(c.isdigit() for c in candidate) and any(c.isalpha() for c in candidate)
        if not (mixed and len(candidate) >= BARE_LENGTH) and not MARK.search(text, max(0, start - REACH), start):
            continue
        if CONTEXT.fullmatch(candidate) or any(a < end and start < b for _, a, b in taken):
            continue
        before, after = surroundings(text, start, end)
        if marginal_bytes(before, candidate, after) >= marginal * len(candidate):
            found.append(("novel", start, end))
    return found


def scan_text(text: str, marginal: float = MARGINAL) -> list[Span]:
    """All spans of a text by start, then kind."""
    lower = text.encode().lower()
    spans = base_spans(text, lower)
    spans += novel_spans(text, lower, spans, marginal)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marginal: float = MARGINAL) -> DataFrame:
    """One row per document: id and `spans`, an array of (kind, start, end)."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, marginal)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], names=["id", "spans"])

    return rows.mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """The documents with each span of their text, overlapping ones as one, replaced by `mark`."""
    place = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else replace(t, mark) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, schema)


def replace(text: str, mark: str) -> str:
    parts, at = [], 0
    for _, start, end in scan_text(text):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]
