"""Joins by keys that may be very uneven: per-key summaries, and tables of large rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import materialize

HEAVY_SHARE = 1000
#: Rows of a heavy key that share a slot of the shuffle, about.
SLOT_ROWS = 1000


def join_summary(
    rows: DataFrame,
    summary: DataFrame,
    key: str,
    count: str,
    heavy_share: int = HEAVY_SHARE,
) -> DataFrame:
    """Rows with their key's summary columns (one summary row per key).

    `count` is the summary's number of rows per key. Keys with more than
    1/heavy_share of all rows are fewer than heavy_share, so their summaries
    are broadcast whatever the data; their rows skip the join by key and are
    spread over as many slots as their count asks for. All other keys take the
    shuffled join. Rows without a key match nothing and are spread likewise.
    The summary is made once and stored, one row per key.
    """
    fields = [c for c in summary.columns if c != key]
    hashable = [f.name for f in rows.schema if "map<" not in f.dataType.simpleString()]
    summary = materialize(summary, "summary")
    total = summary.agg(F.sum(count)).first()[0] or 0
    heavy = F.broadcast(
        summary.where(F.col(count) * heavy_share > total).select(
            F.col(key).alias("_heavy_key"),
            F.struct(*fields).alias("_heavy"),
            F.ceil(F.col(count) / SLOT_ROWS).alias("_slots"),
        )
    )
    # Rows of heavy keys have no key to match and a slot of their own choice.
    # The slot of the others is a hash and not a constant, which the optimizer
    # would take out of the join keys and so out of the partitioning.
    light = summary.select(
        F.col(key).alias("_light_key"),
        F.xxhash64(key).alias("_light_slot"),
        F.struct(*fields).alias("_light"),
    )
    own = F.xxhash64(*[rows[c] for c in hashable])
    everywhere = max(1, -(-total // SLOT_ROWS))
    is_heavy = F.col("_heavy").isNotNull()
    slotted = rows.join(heavy, rows[key] == F.col("_heavy_key"), "left").select(
        *[rows[c] for c in rows.columns],
        "_heavy",
        F.when(~is_heavy, rows[key]).alias("_key"),
        F.when(is_heavy, F.pmod(own, F.col("_slots")))
        .when(rows[key].isNull(), F.pmod(own, F.lit(everywhere)))
        .otherwise(F.xxhash64(rows[key]))
        .alias("_slot"),
    )
    joined = slotted.join(
        light,
        (F.col("_key") == F.col("_light_key")) & (F.col("_slot") == F.col("_light_slot")),
        "left",
    )
    return joined.select(
        *rows.columns,
        *[F.coalesce(F.col(f"_heavy.{c}"), F.col(f"_light.{c}")).alias(c) for c in fields],
    )


def join_replicated(rows: DataFrame, table: DataFrame, keys: list[str], heavy_share: int = HEAVY_SHARE) -> DataFrame:
    """`rows` left-joined with `table`, which is unique by `keys` and may have large rows.

    Keys with more than 1/heavy_share of all rows are fewer than heavy_share. Only they are broadcast,
    each with a number of slots; their rows of `table` are repeated once per slot and the rows that ask for
    them are spread over the slots. The table itself is never broadcast on purpose.
    """
    counts = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "asked")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    heavy = counts.where(F.col("_n") * heavy_share > total).select(
        *[F.col(k).alias(f"_heavy_{k}") for k in keys], F.ceil(F.col("_n") / SLOT_ROWS).cast("int").alias("_slots")
    )

    def with_slots(df: DataFrame) -> DataFrame:
        same = [df[k] == F.col(f"_heavy_{k}") for k in keys]
        return df.join(F.broadcast(heavy), same, "left").select(
            *[df[c] for c in df.columns], F.coalesce("_slots", F.lit(1)).alias("_slots")
        )

    # A hash and not the slot alone: the shuffle then depends on it for all keys alike.
    slot = F.pmod(F.monotonically_increasing_id(), F.col("_slots")).cast("int")
    spread = with_slots(rows).withColumn("_slot", slot).drop("_slots")
    repeated = (
        with_slots(table)
        .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)))
        .drop("_slots")
        .withColumnsRenamed({k: f"_table_{k}" for k in keys} | {"_slot": "_table_slot"})
    )
    same = [F.col(k) == F.col(f"_table_{k}") for k in keys] + [F.col("_slot") == F.col("_table_slot")]
    others = [c for c in table.columns if c not in keys]
    return spread.join(repeated, same, "left").select(*rows.columns, *others)
