"""Mixing of sources by Poisson replication.

Each source has a share of the bytes that are wanted; its mean repetition rate
is the wanted bytes over its own. A document's number of copies is the inverse
of that Poisson distribution at a number hashed from a seed and the document,
so it's the same in every run and on any cluster. Copies are ordered by another
hash: a global shuffle.

A null source is a source of its own. Sources whose texts are all empty have
the rate 1. Null text counts as empty. Documents without an id draw by their
text; repeated rows draw the same number. Weights that name no source of the
table have no effect; a source that isn't named gets the weight 0. An empty
table gives no rows. The documents' own columns travel as one struct, so their names can't clash.

Up to TABLE_RATE a source has a table of its distribution, of bounded size. Above, a document's number is found
in a window of the distribution about as wide as 24 deviations, and its copies are dealt out in
ranges of RANGE before they are made, so that no task makes all copies of a document.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from runlens.llm.common import gapless, text_of
from runlens.operators.skew import join_summary
from runlens.session import materialize

TEMPERATURE = 0.5
SEED = 42
#: Sources whose tables are broadcast (at most 700 numbers each); more of them are joined by key.
FEW_SOURCES = 2_000
TABLE_RATE = 400.0
RANGE = 10_000
#: Above this rate the window would be too wide; the number is then a normal quantile, right to a deviation's hundred-thousandth.
WINDOW_RATE = 1e10
BITS = 52
#: Copies that share a bucket of the global order, about.
BUCKET_ROWS = 1000


def uniform(*parts: Column | str) -> Column:
    """A whole number below 2^52, hashed from the parts."""
    columns = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, BITS // 4), 16, 10).cast("long")


def identity(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.md5(text_of(text_col)))


def poisson_steps(rate: Column) -> Column:
    """Array of 2^52 P(X <= k) for k = 0, 1 ... until nothing below 2^52 is left out.

    In logarithms, so that large rates don't underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    begin = F.struct(
        (-rate).alias("log"),
        F.exp(-rate).alias("sum"),
        F.array(F.floor(F.exp(-rate) * float(1 << BITS)).cast("long")).alias("steps"),
    )

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = state["sum"] + F.exp(log)
        steps = F.concat(state["steps"], F.array(F.floor(total * float(1 << BITS)).cast("long")))
        return F.struct(log.alias("log"), total.alias("sum"), steps.alias("steps"))

    steps = F.aggregate(F.sequence(F.lit(1), last), begin, step, lambda s: s["steps"])
    return F.when(rate > 0, steps).otherwise(F.array(F.lit(1 << BITS)))


@lru_cache(maxsize=4)
def window(rate: float) -> tuple[int, np.ndarray]:
    """First k and 2^52 P(X <= k) from there on, for all k that matter."""
    wide = 12 * math.sqrt(rate) + 30
    first = max(0, math.floor(rate - wide))
    k = np.arange(first + 1, math.ceil(rate + wide) + 1)
    start = first * math.log(rate) - rate - math.lgamma(first + 1)
    logs = np.concatenate([[start], start + np.cumsum(np.log(rate) - np.log(k))])
    # What the logarithms have lost over many steps is taken back: all but nothing lies in the window.
    sums = np.cumsum(np.exp(logs))
    return first, np.floor(sums / sums[-1] * float(1 << BITS)).astype(np.int64)


def inverse(rate: float, draw: int) -> int:
    """The least k with draw < 2^52 P(X <= k)."""
    if rate > WINDOW_RATE:
        return max(0, round(NormalDist(rate, math.sqrt(rate)).inv_cdf((draw + 0.5) / (1 << BITS))))
    first, sums = window(rate)
    return first + int(np.searchsorted(sums, draw, side="right"))


@F.pandas_udf(LongType())
def _inverse(rate: pd.Series, draw: pd.Series) -> pd.Series:
    return pd.Series([inverse(r, d) for r, d in zip(rate.tolist(), draw.tolist())], dtype="int64")


def rates(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    size: float = 1.0,
) -> DataFrame:
    """One row per source: key, rows, bytes, weight, rate.

    Without `weights` a source's weight is its bytes to the power of the
    temperature. `size` is the wanted total over the present one.
    """
    sources = docs.select(source_key(source_col).alias("key"), F.octet_length(text_of(text_col)).alias("n")).groupBy("key").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("n").cast("long").alias("bytes")
    )
    if weights is None:
        weight = F.when(F.col("bytes") > 0, F.pow(F.col("bytes").cast("double"), F.lit(temperature))).otherwise(F.lit(0.0))
    else:
        pairs = [x for name, w in weights.items() for x in (F.lit(f"s{name}"), F.lit(float(w)))]
        weight = F.coalesce(F.element_at(F.create_map(*pairs), F.col("key")), F.lit(0.0)) if pairs else F.lit(0.0)
    weighted = materialize(sources.withColumn("weight", weight), "sources")
    totals = weighted.agg(
        F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("bytes") > 0, F.col("weight"))).alias("weights")
    ).first()
    all_weights = F.nullif(F.lit(float(totals["weights"] or 0)), F.lit(0.0))
    wanted = F.col("weight") / all_weights * F.lit(int(totals["bytes"] or 0)) * size / F.col("bytes")
    return weighted.select(
        "key", "rows", "bytes", "weight",
        F.when(F.col("bytes") > 0, F.coalesce(wanted, F.lit(0.0))).otherwise(F.lit(1.0)).alias("rate"),
    )


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))


def replicate(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    seed: int = SEED,
    **target: object,
) -> DataFrame:
    """Each row of `docs` as a struct `doc`, as often as drawn, with `copy` (from 1) and `order` (below 2^52)."""
    steps = materialize(
        rates(docs, source_col, text_col, **target).select(
            "key", "rows", "rate", F.when(F.col("rate") <= TABLE_RATE, poisson_steps(F.col("rate"))).alias("steps")
        ),
        "rates",
    )
    drawn = docs.select(
        F.struct("*").alias("doc"),
        source_key(source_col).alias("key"),
        identity(id_col, text_col).alias("name"),
    ).withColumn("draw", uniform(str(seed), F.col("name")))
    if steps.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        joined = drawn.join(F.broadcast(steps.select("key", "rate", "steps")), "key")
    else:
        joined = join_summary(drawn, steps, "key", "rows")
    few = joined.where("steps is not null").withColumn("copies", F.size(F.filter("steps", lambda s: s <= F.col("draw"))))
    copied = few.where("copies > 0").select("doc", "name", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    if steps.where(F.col("rate") > TABLE_RATE).limit(1).count():
        many = joined.where("steps is null").withColumn("copies", _inverse("rate", "draw").cast("int")).where("copies > 0")
        begins = F.sequence(F.lit(1), F.col("copies"), F.lit(RANGE))
        dealt = many.select("doc", "name", "copies", F.explode(begins).alias("begin")).repartition("name", "begin")
        upto = F.least(F.col("begin") + (RANGE - 1), F.col("copies"))
        copied = copied.unionAll(dealt.select("doc", "name", F.explode(F.sequence(F.col("begin"), upto)).alias("copy")))
    order = uniform(str(seed), F.lit("order"), F.col("name"), F.col("copy").cast("string"))
    return copied.select("doc", "copy", order.alias("order"))


def mix(docs: DataFrame, **target: object) -> DataFrame:
    """The replicated documents in random order, with their own columns."""
    dealt = replicate(docs, **target).repartition("order").sortWithinPartitions("order")
    return dealt.select("doc.*")


def positions(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **target: object
) -> DataFrame:
    """id, source, copy and the copy's position in the global order, from 0."""
    columns = [F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{source_col}").alias("source"), "copy", "order"]
    drawn = materialize(replicate(docs, id_col, source_col, text_col, **target).select(*columns), "drawn")
    # The order is uniform, so equal ranges of it hold about as many copies each.
    buckets = max(1, drawn.count() // BUCKET_ROWS)
    width = -(-(1 << BITS) // buckets)
    numbered = gapless(
        drawn.withColumn("bucket", F.floor(F.col("order") / width).cast("long")),
        [], "bucket", [F.col("order"), F.col("id"), F.col("copy")], "position",
    )
    return numbered.select("id", "source", "copy", "position")
