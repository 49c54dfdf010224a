"""Anti-joins in which rows with new ids are never moved.

The finished ids become a Bloom filter: numbered words of 64 bits, made by partial aggregates
and gathered into one array of a bounded size, which the plan hands to every task as a
scalar. An id with a bit that is not set is new for certain; its row stays where it is.
Only the other rows, about as many as there are finished ids among them, are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each id and how many of them it sets: about 1 of 120 new ids looks finished.
BITS_PER_ID = 10
HASHES = 7
#: Words of the largest filter (8 MiB); for more ids the join is done without one.
MOST_WORDS = 1 << 20
WORD = 64


def filter_words(n: int) -> int:
    """Words of a filter for n ids, a power of two."""
    return 1 << max(0, -(-n * BITS_PER_ID // WORD) - 1).bit_length()


def _places(key: str, words: int) -> Column:
    """The numbers of the bits of an id."""
    size = F.lit(words * WORD).cast("long")
    first, second = F.pmod(F.xxhash64(key), size), F.pmod(F.xxhash64(key, F.lit(1)), size).bitwiseOR(F.lit(1))
    return F.array(*[F.pmod(first + F.lit(i) * second, size) for i in range(HASHES)])


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD).cast("int"))


def bloom_filter(ids: DataFrame, key: str, words: int) -> Column:
    """The filter as a scalar array of `words` numbers."""
    bits = (
        ids.where(F.col(key).isNotNull())
        .select(F.explode(_places(key, words)).alias("place"))
        .select(F.floor(F.col("place") / WORD).alias("word"), _bit(F.col("place")).alias("bits"))
    )
    none = ids.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    ordered = bits.unionAll(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # Exactly `words` rows, whatever the number of ids.
    return ordered.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])).scalar()


def may_hold(words: Column, size: int, key: str) -> Column:
    """Whether all bits of the id are set; false for null ids."""
    held = F.lit(True)
    for i in range(HASHES):
        place = _places(key, size)[i]
        held = held & (F.get(words, F.floor(place / WORD).cast("int")).bitwiseAND(_bit(place)) != 0)
    return F.coalesce(F.col(key).isNotNull() & held, F.lit(False))


def without(rows: DataFrame, done: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rows whose id is not in `done`; rows with null ids stay.

    `rows` is read twice: once for the new ids, once for those that may be finished.
    """
    finished = done.select(key)
    n = finished.count()
    size = filter_words(n)
    if size > MOST_WORDS:
        return rows.join(finished, key, "left_anti")
    words = bloom_filter(finished, key, size)
    held = may_hold(words, size, key)
    fresh = rows.where(~held)
    return fresh.unionAll(rows.where(held).join(finished, key, "left_anti").select(*rows.columns))
