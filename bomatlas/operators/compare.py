"""Overlap of two repositories' packages, for a whole frame of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomatlas.functions.numbers import overlap_pct
from bomatlas.operators.ranking import top_per_group

# Fixed value: labels listed per class.
MAX_LABELS = 100

PAIR = ["repo_a", "repo_b"]


def package_sets(by_repo: DataFrame) -> DataFrame:
    """Distinct packages per repository with one name each."""
    return by_repo.groupBy("repo_full_name", "ecosystem", "package_key").agg(
        F.min("package_name").alias("package_name")
    )


def matched_packages(by_repo: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per (pair, package): in_a, in_b and the label.

    A full outer match written as a grouping: each pair asks for its two repositories,
    one equi join brings their packages, and the sides fold into two flags. The label
    is repository a's when both have the package.
    """
    asked = pairs.select(*PAIR).distinct()
    sides = asked.select(
        *PAIR,
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("repo_a").alias("repo_full_name")),
                F.struct(F.lit("b").alias("side"), F.col("repo_b").alias("repo_full_name")),
            )
        ).alias("s"),
    ).select(*PAIR, "s.*")
    return (
        sides.join(package_sets(by_repo), "repo_full_name")
        .groupBy(*PAIR, "ecosystem", "package_key")
        .agg(
            F.max(F.col("side") == "a").alias("in_a"),
            F.max(F.col("side") == "b").alias("in_b"),
            F.min(F.struct("side", "package_name")).alias("first"),
        )
        .select(
            *PAIR,
            "ecosystem",
            "package_key",
            "in_a",
            "in_b",
            F.concat("ecosystem", F.lit(":"), "first.package_name").alias("label"),
        )
    )


def dependency_compare(by_repo: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sizes, shared count and overlap per pair; a pair without packages gives zeros."""
    both = F.col("in_a") & F.col("in_b")
    counted = (
        matched_packages(by_repo, pairs)
        .groupBy(*PAIR)
        .agg(
            F.count_if("in_a").alias("deps_a"),
            F.count_if("in_b").alias("deps_b"),
            F.count_if(both).alias("shared_count"),
            F.count("*").alias("union_count"),
        )
    )
    zeros = {c: 0 for c in ("deps_a", "deps_b", "shared_count", "union_count")}
    return (
        pairs.select(*PAIR)
        .distinct()
        .join(counted, PAIR, "left")
        .fillna(zeros)
        .withColumn("overlap_pct", overlap_pct(F.col("shared_count"), F.col("union_count")))
    )


def shared(by_repo: DataFrame, pairs: DataFrame) -> DataFrame:
    return matched_packages(by_repo, pairs).where("in_a AND in_b").select(*PAIR, "label")


def only_in_a(by_repo: DataFrame, pairs: DataFrame) -> DataFrame:
    return matched_packages(by_repo, pairs).where("in_a AND NOT in_b").select(*PAIR, "label")


def only_in_b(by_repo: DataFrame, pairs: DataFrame) -> DataFrame:
    return matched_packages(by_repo, pairs).where("in_b AND NOT in_a").select(*PAIR, "label")


def listed_labels(by_repo: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair the first 100 labels of each class, as arrays.

    Labels are ranked per (pair, class) before they are collected.
    """
    classed = matched_packages(by_repo, pairs).select(
        *PAIR,
        F.when(F.col("in_a") & F.col("in_b"), "shared")
        .when(F.col("in_a"), "only_in_a")
        .otherwise("only_in_b")
        .alias("class"),
        "label",
        "package_key",
    )
    ranked = top_per_group(
        classed, [*PAIR, "class"], [F.asc("label"), F.asc("package_key")], MAX_LABELS
    )
    return ranked.groupBy(*PAIR).agg(
        *[
            F.transform(
                F.sort_array(
                    F.collect_list(F.when(F.col("class") == c, F.struct("rank", "label")))
                ),
                lambda x: x["label"],
            ).alias(c)
            for c in ("shared", "only_in_a", "only_in_b")
        ]
    )
