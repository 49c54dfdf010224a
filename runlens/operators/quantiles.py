"""Exact distribution figures without holding a group in one task.

Values are counted per distinct value. The ranks that percentiles need are then
found along the 64 bits of a double, 16 at a time: a pass counts rows per next
prefix below the prefixes that still hold a wanted rank, and keeps the ones that
do. Only counts are shuffled, every pass is a partial aggregate, and a window
never sees more than 65536 counts, however the values are concentrated. The distinct
values are stored once with their bits, since every pass reads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.session import materialize

PERCENTILES = (10, 25, 50, 75, 90)
STEP_BITS = 16
# The layout of a double: 52 bits of fraction, the exponent with this bias, least normal value 2**-1022.
_FRACTION, _BIAS, _LEAST = 1 << 52, 1023, 2.0**-1022


def ordered_bits(value: Column) -> Column:
    """A whole number for each double, in the same order: the bits of its size, with its sign.

    Scaling by powers of two is exact, so nothing is lost; 0.0 and -0.0 give 0, NaN the largest number.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(size)).cast("double")
    first = size / F.pow(F.lit(2.0), guess)
    exponent = guess + F.when(first >= 2, 1).when(first < 1, -1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1) * float(_FRACTION)).cast("bigint")
    normal = (exponent.cast("bigint") + _BIAS) * F.lit(_FRACTION) + fraction
    tiny = (size * 2.0**537 * 2.0**537).cast("bigint")
    bits = (
        F.when(F.isnan(value), F.lit(2048 * _FRACTION - 1))
        .when(size == float("inf"), F.lit(2047 * _FRACTION))
        .when(size >= _LEAST, normal)
        .otherwise(tiny)
    )
    return F.when(value < 0, -bits).otherwise(bits)


def from_ordered_bits(code: Column) -> Column:
    bits = F.abs(code)
    exponent = F.shiftright(bits, 52)
    fraction = bits.bitwiseAND(F.lit(_FRACTION - 1)).cast("double")
    normal = (fraction / float(_FRACTION) + 1) * F.pow(F.lit(2.0), (exponent - _BIAS).cast("double"))
    size = (
        F.when(exponent == 0, fraction / 2.0**537 / 2.0**537)
        .when(exponent < 2047, normal)
        .otherwise(F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))
    )
    return F.when(code < 0, -size).otherwise(size)


def histogram(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct value: groups, `value`, `weight`; a group without values keeps a row of weight 0."""
    return df.groupBy(*groups, (F.col(value).cast("double") + 0.0).alias("value")).agg(
        F.count(F.col(value)).alias("weight")
    )


def weighted_stats(
    counted: DataFrame,
    groups: Sequence[str],
    percents: Sequence[int] = PERCENTILES,
    small_groups: bool = False,
) -> DataFrame:
    """n, mean, std (population), min, max and p10, p25, ... per group; n = 0 and nulls without values.

    `counted` has group columns without nulls, `value` (double) and `weight`;
    a value may occur in several rows. Percentiles interpolate linearly. Set
    `small_groups` when the query itself fixes the number of groups: the tables
    of moments and ranks then have a fixed size and are broadcast.
    """
    groups = list(groups)

    def attach(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if small_groups else table

    code = F.when(F.col("weight") > 0, ordered_bits(F.col("value"))).alias("code")
    counted = materialize(counted.select(*groups, "value", "weight", code), "values")
    v, w = F.col("value"), F.col("weight")
    moments = counted.groupBy(*groups).agg(
        F.sum("weight").alias("n"),
        F.try_divide(F.sum(v * w), F.sum(w)).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    away = F.col("value") - F.col("mean")
    spread = (
        counted.join(attach(moments.select(*groups, "mean")), groups)
        .groupBy(*groups)
        .agg(F.sqrt(F.try_divide(F.sum(w * away * away), F.sum(w))).alias("std"))
    )

    at = "(n - 1) * p / 100D"
    wanted = moments.where("n > 0").select(
        *groups,
        F.lit(0).cast("bigint").alias("prefix"),
        F.expr(
            f"""transform(array_distinct(flatten(transform(array({', '.join(map(str, percents))}),
            p -> array(floor({at}), ceil({at}))))), r -> named_struct('rank', r, 'before', 0L))"""
        ).alias("ranks"),
    )
    coded = counted.where("weight > 0").select(*groups, "code", "weight")
    for shift in range(64 - STEP_BITS, -1, -STEP_BITS):
        # Stored, since the next pass reads it twice.
        wanted = materialize(_next_prefix(coded, attach(wanted), groups, shift), "ranks")
    found = wanted.select(*groups, from_ordered_bits(F.col("prefix")).alias("value"), F.explode("ranks").alias("r"))
    # At most two entries per percentile.
    ranked = found.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("r.rank", "value"))).alias("_at"))

    def percentile(p: int) -> Column:
        place = f"((n - 1) * {p} / 100D)"
        low, high = f"element_at(_at, floor({place}))", f"element_at(_at, ceil({place}))"
        share = f"({place} - floor({place}))"
        return F.expr(f"case when {share} = 0 then {low} else {low} * (1 - {share}) + {high} * {share} end").alias(f"p{p}")

    return (
        moments.join(attach(spread), groups)
        .join(attach(ranked), groups, "left")
        .select(*groups, "n", "mean", "std", "min", "max", *[percentile(p) for p in percents])
    )


def _next_prefix(coded: DataFrame, wanted: DataFrame, groups: list[str], shift: int) -> DataFrame:
    """The prefixes, STEP_BITS longer, that hold the wanted ranks; `before` counts the rows of the group below."""
    # Before the first step there is one prefix, 0, for all codes.
    earlier = F.shiftright("code", shift + STEP_BITS) if shift + STEP_BITS < 64 else F.lit(0).cast("bigint")
    below = coded.select(*groups, earlier.alias("prefix"), F.shiftright("code", shift).alias("next"), "weight")
    # The ranks are joined behind the aggregate, whose keys are then plain numbers and names.
    sizes = below.join(wanted.select(*groups, "prefix"), [*groups, "prefix"]).groupBy(*groups, "prefix", "next").agg(
        F.sum("weight").alias("size")
    )
    within = Window.partitionBy(*groups, "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("first", F.sum("size").over(within) - F.col("size")).join(wanted, [*groups, "prefix"])
    held = F.expr(
        """transform(filter(ranks, r -> r.rank >= r.before + first and r.rank < r.before + first + size),
        r -> named_struct('rank', r.rank, 'before', r.before + first))"""
    )
    return placed.select(*groups, F.col("next").alias("prefix"), held.alias("ranks")).where(F.size("ranks") > 0)


def distribution_stats(
    df: DataFrame, groups: Sequence[str], value: str, small_groups: bool = False
) -> DataFrame:
    """n, mean, median, population std, p10/p25/p75/p90, min and max per group."""
    return stats_columns(
        weighted_stats(histogram(df, groups, value), groups, small_groups=small_groups), groups
    )


def stats_columns(stats: DataFrame, groups: Sequence[str]) -> DataFrame:
    return stats.select(
        *groups,
        "n",
        "mean",
        F.col("p50").alias("median"),
        "std",
        "p10",
        "p25",
        "p75",
        "p90",
        "min",
        "max",
    )


def approx_distribution(
    df: DataFrame, groups: Sequence[str], value: str, accuracy: int = 10000
) -> DataFrame:
    """The cheaper choice where a rank error of 1/accuracy is good enough."""
    shares = [p / 100 for p in PERCENTILES]
    v = F.col(value).cast("double")
    found = df.groupBy(*groups).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.percentile_approx(v, shares, accuracy).alias("_q"),
    )
    named = [F.col("_q")[i].alias(f"p{p}") for i, p in enumerate(PERCENTILES)]
    return stats_columns(found.select(*groups, "n", "mean", "std", "min", "max", *named), groups)
