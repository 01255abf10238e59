"""Top-k per group and exact percentiles that hold up when one group is huge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this rank Spark itself cuts every map task's rows to k per group before the
# shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
_NATIVE_LIMIT = 1000
_SLICES = 64
# Buckets a group's values are cut into for percentiles.
_BUCKETS = 64


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], limit: int, offset: int = 0
) -> DataFrame:
    """Rows ranked ``offset < rank <= offset + limit`` within each group, with ``rank``.

    ``order`` must be total. A group may hold any share of the rows: for small k the
    window's own limit runs before the shuffle; beyond that the group is first cut into
    slices by the hash of the row, ranked there, and only the survivors of each slice
    meet in one task.
    """
    deepest = offset + limit
    if deepest > _NATIVE_LIMIT:
        sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            df.withColumn("_slice", F.pmod(F.xxhash64(*df.columns), F.lit(_SLICES)))
            .withColumn("rank", F.row_number().over(sliced))
            .where(F.col("rank") <= deepest)
            .drop("rank", "_slice")
        )
    whole = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= deepest)
    return ranked.where(F.col("rank") > offset) if offset else ranked


def percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    points: dict[str, float],
    method: str = "linear",
    buckets: int = _BUCKETS,
) -> DataFrame:
    """Exact percentiles per group, one column per entry of ``points`` (0..1).

    ``method="linear"`` interpolates between neighbours; ``"floor"`` takes the value at
    index ``min(floor(n * p), n - 1)``.

    Rows are counted per (group, value) before anything else. The running count is then
    built in two levels, per bucket of values and inside each bucket. Buckets are cut at
    approximate quantiles of the group's own distinct values, so each holds about as many of
    them, whatever the scale of the values; where the cuts fall doesn't change the result.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    cuts = F.percentile_approx("_v", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("_cuts")
    if keys:
        counted = counted.join(counted.groupBy(*keys).agg(cuts), keys)
    else:  # a few dozen numbers
        found = counted.agg(cuts).first()[0] or []
        counted = counted.withColumn("_cuts", F.array(*[F.lit(c) for c in found]).cast("array<double>"))
    counted = counted.withColumn("_bucket", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        counted.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_in_bucket"))
        .withColumns(
            {
                "_offset": F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)),
                "_total": F.sum("_in_bucket").over(Window.partitionBy(*keys)),
            }
        )
        .drop("_in_bucket")
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    # NULL group keys would not match in an equi join; callers pass non-null keys.
    ranked = counted.join(sums, [*keys, "_bucket"]).withColumn(
        "_upto", F.col("_offset") + F.sum("_n").over(within)
    )

    def value_at(index: Column) -> Column:
        return F.min(F.when(F.col("_upto") > index, F.col("_v")))

    columns = []
    for name, p in points.items():
        if method == "floor":
            index = F.least(
                F.floor(F.col("_total") * F.lit(round(p * 100, 6)) / F.lit(100)), F.col("_total") - 1
            )
            columns.append(value_at(index).alias(name))
        elif method == "linear":
            at = (F.col("_total") - 1).cast("double") * F.lit(p)
            low, high = value_at(F.floor(at)), value_at(F.ceil(at))
            part = F.max(at - F.floor(at))
            columns.append((low + (high - low) * part).alias(name))
        else:
            raise ValueError("method must be 'linear' or 'floor'")
    return ranked.groupBy(*keys).agg(*columns)
