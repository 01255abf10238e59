"""Which points lie in which spans, without a pair for the spans that a point lies outside of.

Points of a group are ranked, and a span becomes the ranks it covers. It is cut into dyadic
intervals, at most two for each power of two, and a point stands in exactly one interval of
each size; a point and a span then share at most one interval, so an equi join finds each
match once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Place of a row among rows with its key: what counts the points below, the points, what counts the point as well.
_BELOW, _POINT, _UPTO = 0, 1, 2


def ranked_points(points: DataFrame, keys: list[str], key: str) -> DataFrame:
    """``keys, key, _rank``: the distinct points of each group, from 0."""
    order = Window.partitionBy(*keys).orderBy(key)
    return points.where(F.col(key).isNotNull()).select(*keys, key).distinct().withColumn("_rank", (F.row_number().over(order) - 1).cast("bigint"))


def covered_ranks(points: DataFrame, spans: DataFrame, keys: list[str], key: str, low: str, below: str, upto: str) -> DataFrame:
    """``spans`` with ``_from`` and ``_to``: the ranks a span covers are those from the first up to, not with, the second.

    A span begins at ``low`` and ends before ``below`` or with ``upto``; nulls leave it open.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in spans.columns])
    bounds = spans.select(
        *keys,
        own.alias("_span"),
        F.explode(
            F.array(
                F.struct(F.lit("low").alias("of"), F.lit(_BELOW).alias("place"), F.col(low).alias("key")),
                F.struct(F.lit("below").alias("of"), F.lit(_BELOW).alias("place"), F.col(below).alias("key")),
                F.struct(F.lit("upto").alias("of"), F.lit(_UPTO).alias("place"), F.col(upto).alias("key")),
            )
        ).alias("_bound"),
    ).select(*keys, "_span", "_bound.*")
    none = F.lit(None).cast(bounds.schema["_span"].dataType)
    rows = bounds.unionByName(
        points.select(*keys, none.alias("_span"), F.lit(None).cast("string").alias("of"), F.lit(_POINT).alias("place"), F.col(key).alias("key"))
    )
    # Bounds that are open come first and count nothing; an open end takes all points below.
    before = Window.partitionBy(*keys).orderBy(F.col("key").asc_nulls_first(), "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    is_point = F.col("of").isNull().cast("bigint")
    counted = rows.withColumns({"_n": F.coalesce(F.sum(is_point).over(before), F.lit(0)), "_all": F.sum(is_point).over(every)}).where("of is not null")

    def at(bound: str, open_: Column) -> Column:
        own_key = F.when(F.col("key").isNull(), open_).otherwise(F.col("_n"))
        return F.max(F.when(F.col("of") == bound, own_key))

    found = counted.groupBy(*keys, "_span").agg(
        at("low", F.lit(0).cast("bigint")).alias("_from"), F.least(at("below", F.col("_all")), at("upto", F.col("_all"))).alias("_to")
    )
    return found.select("_span.*", "_from", "_to").where("_from < _to")


def merged(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, _from, _to``: the ranks that any span of a group covers, as spans that don't overlap or touch."""
    before = Window.partitionBy(*keys).orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("_from", "_to").rowsBetween(Window.unboundedPreceding, 0)
    apart = F.coalesce(F.col("_from") > F.max("_to").over(before), F.lit(True)).cast("int")
    pieces = spans.select(*keys, "_from", "_to", apart.alias("_new")).withColumn("_piece", F.sum("_new").over(upto))
    return pieces.groupBy(*keys, "_piece").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to")).drop("_piece")


def span_nodes(spans: DataFrame) -> DataFrame:
    """A row for each dyadic interval of ``_from`` to ``_to``: ``_level`` and ``_node``."""
    levels = spans.withColumn("_level", F.explode(F.expr("sequence(0, cast(floor(log2(_to - _from)) as int))")))
    cut = levels.withColumns(
        {"_a": F.expr("shiftright(_from + shiftleft(1L, _level) - 1, _level)"), "_b": F.expr("shiftright(_to, _level)")}
    ).where("_a < _b")
    first, last = F.when(F.expr("_a % 2 = 1"), F.col("_a")), F.when(F.expr("_b % 2 = 1"), F.col("_b") - 1)
    return cut.withColumn("_node", F.explode(F.array_compact(F.array(first, last)))).drop("_a", "_b", "_from", "_to")


def point_nodes(points: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each dyadic interval that holds the point, up to the size of its group."""
    size = F.max("_rank").over(Window.partitionBy(*keys)) + 1
    leveled = points.withColumn("_size", size).withColumn("_level", F.explode(F.expr("sequence(0, cast(floor(log2(_size)) as int))")))
    return leveled.withColumn("_node", F.expr("shiftright(_rank, _level)")).drop("_rank", "_size")


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str], key: str, low: str, below: str, upto: str) -> DataFrame:
    """``points`` (``keys`` and ``key``, repeats counting once) beside each span of their group that holds them.

    Columns: those of ``points``, and of ``spans`` without ``keys``.
    """
    ranked = ranked_points(points, keys, key)
    covered = span_nodes(covered_ranks(ranked, spans, keys, key, low, below, upto))
    return point_nodes(ranked, keys).join(covered, [*keys, "_level", "_node"]).drop("_level", "_node")
