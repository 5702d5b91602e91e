"""Top-k, row numbers and order statistics that do not gather a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmine.session import lookup_join, stage

# Scores are compared in steps of 1e-9, so that two copies of a text tie (and
# are ordered by id) whatever the order in which their terms were summed.
_STEP = 1e9


def score_key(score: Column) -> Column:
    return F.floor(score * F.lit(_STEP) + F.lit(0.5))


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each key with their 1-based rank.

    The ``rank <= k`` test lets Spark cut every partition to ``k`` rows per key
    before the shuffle, so a key with a third of all rows moves few rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def with_row_index(df: DataFrame, *order: Column | str, name: str = "row_index") -> DataFrame:
    """Global 0-based row number in the given (total) order, without a one-task window.

    Rows are range-sorted and numbered within their partition by
    ``monotonically_increasing_id``; the partitions' sizes (one row each) then
    give every partition its offset. The sorted rows are written first, since
    sizes and numbers must come from the same partitioning.
    """
    tagged = df.orderBy(*order).withColumn("_mono", F.monotonically_increasing_id())
    placed = stage(tagged, "sorted")
    part = F.shiftright("_mono", 33)
    local = F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    # offsets has one row per sort partition, at most spark.sql.shuffle.partitions.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + local)
        .drop("_part", "_mono", "_offset")
    )


# Points of the sketch that brackets a value, and values of a bracket that are put in order.
_GRID, _SORTED = 256, 100_000


def order_statistics(
    df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], most_sorted: int = _SORTED
) -> DataFrame:
    """``sorted(values)[floor(n * p)]`` for each named fraction, one row per key.

    This is an element of the list, neither interpolated nor the discrete
    percentile: for 1..20 the 0.5 statistic is 11 and the 0.95 statistic is 20. Nulls are left out.

    Values are selected, not sorted. A quantile sketch of each key gives two of its values between which the wanted
    one lies; counting the values below, at and between them tells whether one of the two is wanted, or which of
    those between. These go through the same again until few are left. Each round leaves about a
    hundredth of the values; equal ones are counted together and end the search. What is shuffled are sketches and counts.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0), *keys).alias("_g"), F.col(value).alias("_v"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.lit(p).alias("_p")) for n, p in fractions.items()]))
    wanted, found, on = None, [], ["_g"]
    while True:
        points = F.percentile_approx("_v", [i / _GRID for i in range(_GRID + 1)], F.lit(10_000))
        sketches = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), points.alias("_points"))
        if wanted is None:
            asked = sketches.select("*", names.alias("_f")).select(
                "_g", "_n", "_points", "_f._name", F.floor(F.col("_n") * F.col("_f._p")).alias("_r"))
        else:
            asked = sketches.join(wanted, on)
        place = F.floor(F.col("_r") * _GRID / F.col("_n")).cast("int")
        brackets = stage(asked.select(
            "_g", "_name", "_r", F.get("_points", F.greatest(place - 1, F.lit(0))).alias("_lo"),
            F.get("_points", F.least(place + 2, F.lit(_GRID))).alias("_hi")), "brackets")
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        counts = lookup_join(rows, brackets, on, ["_v"]).groupBy("_g", "_name", "_r", "_lo", "_hi").agg(
            F.count_if(v < lo).alias("_below"), F.count_if(v == lo).alias("_at_lo"),
            F.count_if((v > lo) & (v < hi)).alias("_between"), F.count_if((v == hi) & (hi > lo)).alias("_at_hi"))
        r, below, at_lo = F.col("_r"), F.col("_below"), F.col("_below") + F.col("_at_lo")
        between, at_hi = at_lo + F.col("_between"), at_lo + F.col("_between") + F.col("_at_hi")
        # Outside of the bracket (the sketch is not exact) the search goes on there.
        judged = stage(counts.select(
            "_g", "_name",
            F.when((r >= below) & (r < at_lo), lo).when((r >= between) & (r < at_hi), hi).alias("_found"),
            F.when(r < below, None).when(r < between, lo).otherwise(hi).alias("_from"),
            F.when(r < below, lo).when(r < between, hi).alias("_to"),
            F.when(r < below, r).when(r < between, r - at_lo).otherwise(r - at_hi).alias("_r"),
        ), "judged")
        found.append(judged.where(F.col("_found").isNotNull()).select("_g", "_name", "_found"))
        open_ = judged.where(F.col("_found").isNull()).drop("_found")
        rows = stage(lookup_join(rows, open_, on, ["_v"]).where(
            (F.col("_from").isNull() | (v > F.col("_from"))) & (F.col("_to").isNull() | (v < F.col("_to")))
        ).select("_g", "_name", "_v"), "between")
        on, wanted = ["_g", "_name"], open_.select("_g", "_name", "_r")
        left = rows.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
        if left <= most_sorted:
            break
    order = Window.partitionBy(*on).orderBy("_v")
    found.append(rows.withColumn("_i", F.row_number().over(order) - 1).join(wanted, on).where("_i = _r").select(
        "_g", "_name", F.col("_v").alias("_found")))
    return reduce(DataFrame.unionByName, found).groupBy("_g").agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_found"))).alias(name) for name in fractions]
    ).select(*[F.col("_g")[k].alias(k) for k in keys], *fractions)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in ``order``; every partition sends one row per key at most."""
    return top_k(df, keys, order, 1, "_latest").drop("_latest")
