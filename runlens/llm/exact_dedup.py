"""Exact deduplication with the frequent texts split off.

A Misra-Gries summary per partition finds the digests that may be frequent.
The merged summary keeps at most `counters` + 1 of them, so their exact winners
can be broadcast: rows of frequent texts never meet in one task. All other
digests are grouped by an ordinary shuffle, in which no group is large.

Null text counts as empty. Null ids come last: a text whose rows all lack an id
has a null `keep_id`. Of rows repeated with id and text one is kept. An empty
table gives no rows. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import BLANKS, first_id, tagged, text_of
from runlens.session import materialize

COUNTERS = 1000


def digest(text: str) -> Column:
    """SHA-256 of the text with each run of blanks as one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), BLANKS, " "), 256))


def _shrink(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {key: n - cut for key, n in counts.items() if n > cut}


def frequent(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """Keys that may be frequent, at most `counters` + 1; all with 2 rows in `counters` + 1 or more are among them.

    Each partition keeps `counters` Misra-Gries counters; their sums stay below
    the true counts by at most one row in `counters` + 1.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for value, n in Counter(batch.column(0).to_pylist()).items():
                counts[value] = counts.get(value, 0) + n
            counts = _shrink(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=[key, "estimate"]
        )

    total = rows.count()
    merged = rows.select(key).mapInArrow(summarise, f"{key} binary, estimate long").groupBy(key).agg(
        F.sum("estimate").alias("estimate")
    )
    return merged.where(F.col("estimate") * (counters + 1) >= total).select(key)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: id, digest, keep_id, group_size, kept."""
    rows = tagged(docs.select(F.col(id_col).alias("id"), digest(text_col).alias("digest")), "digests")
    summary = [F.count(F.lit(1)).alias("group_size"), first_id("id").alias("winner")]
    suspects = materialize(frequent(rows, "digest", counters), "frequent")
    winners = materialize(rows.join(F.broadcast(suspects), "digest").groupBy("digest").agg(*summary), "winners")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    rest = marked.where(F.col("group_size").isNull()).select(*rows.columns)
    others = rest.join(rest.groupBy("digest").agg(*summary), "digest")
    return (
        marked.where(F.col("group_size").isNotNull())
        .unionByName(others)
        .select(
            "id",
            "digest",
            F.col("winner.id").alias("keep_id"),
            "group_size",
            (F.col("winner.row") == F.col("_row")).alias("kept"),
        )
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns."""
    winners = groups(docs, id_col, text_col).where("kept").select(
        F.col("id").alias("_keep_id"), F.col("digest").alias("_keep_digest")
    )
    return one_each(docs, winners, id_col, digest(text_col))


def one_each(docs: DataFrame, winners: DataFrame, id_col: str, key: Column) -> DataFrame:
    """One row of `docs` for each winner (_keep_id, _keep_digest); the window follows the join's own order."""
    found = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), key.alias("digest")).join(
        winners, F.col("id").eqNullSafe(F.col("_keep_id")) & (F.col("digest") == F.col("_keep_digest")), "left_semi"
    )
    copies = Window.partitionBy("id", "digest").orderBy("digest")
    return found.withColumn("copy", F.row_number().over(copies)).where("copy = 1").select("doc.*")
