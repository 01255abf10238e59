"""Use of packages over the retained snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKAGE = ["ecosystem", "package_key"]


def snapshots(fact: DataFrame) -> DataFrame:
    """Distinct repositories per package and snapshot date."""
    return fact.groupBy(*PACKAGE, "ingested_date").agg(
        F.count_distinct("repo_full_name").alias("repo_count")
    )


def with_changes(per_snapshot: DataFrame) -> DataFrame:
    """Add the change since the previous snapshot. A group has one row per snapshot."""
    order = Window.partitionBy(*PACKAGE).orderBy("ingested_date")
    return per_snapshot.withColumn(
        "change", F.col("repo_count") - F.lag("repo_count").over(order)
    )


def dependency_trends(fact: DataFrame) -> DataFrame:
    """Per package: snapshots, first and last count, their difference, and the note."""
    summary = (
        snapshots(fact)
        .groupBy(*PACKAGE)
        .agg(
            F.count("*").alias("snapshots"),
            F.min(F.struct("ingested_date", "repo_count")).alias("first"),
            F.max(F.struct("ingested_date", "repo_count")).alias("last"),
        )
    )
    delta = F.col("last.repo_count") - F.col("first.repo_count")
    return summary.select(
        *PACKAGE,
        "snapshots",
        F.col("first.repo_count").alias("first_count"),
        F.col("last.repo_count").alias("last_count"),
        delta.alias("delta"),
        F.when(
            F.col("snapshots") < 2,
            F.lit("Only one snapshot retained so far."),
        )
        .otherwise(
            F.concat(
                F.when(delta >= 0, "+").otherwise(""),
                delta.cast("string"),
                F.lit(" repos over "),
                F.col("snapshots").cast("string"),
                F.lit(" snapshots."),
            )
        )
        .alias("note"),
    )
