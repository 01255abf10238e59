"""Summary tables over one snapshot of the fact table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names that stand for a missing licence, per table.
ROLLUP_UNKNOWN = "UNKNOWN"
LANDSCAPE_NONE = "NONE"
# Fixed value: ecosystems that the statistics of a build name first.
TOP_ECOSYSTEMS = 8


def real_packages(fact: DataFrame) -> DataFrame:
    """Without self references and CI actions."""
    return fact.where(~F.col("is_self_ref") & ~F.col("is_action"))


def pkg_popularity(fact: DataFrame) -> DataFrame:
    """Per package: a name, distinct repositories, distinct versions ('' is a version).

    Each count has a grouping of its own, by (package, repository) and by (package, version),
    which shrinks in every task: no row is written twice, as two distinct counts in one
    aggregate would, and a package with a third of the rows is counted by many tasks.
    """
    package = ["ecosystem", "package_key"]
    rows = real_packages(fact)
    by_repo = rows.groupBy(*package, "repo_full_name").agg(F.min("package_name").alias("name"))
    by_version = rows.where("version_raw is not null").groupBy(*package, "version_raw").agg(F.lit(1).alias("one"))
    repos = by_repo.groupBy(*package).agg(F.min("name").alias("package_name"), F.count("*").alias("repo_count"))
    versions = by_version.groupBy(*package).agg(F.count("*").alias("version_count"))
    return repos.join(versions, package, "left").withColumn("version_count", F.coalesce("version_count", F.lit(0)).cast("bigint"))


def license_rollup(fact: DataFrame) -> DataFrame:
    """Per (ecosystem, licence): distinct repositories and occurrences.

    The missing licence is named before grouping; grouping by ``license_id`` would bind
    to the input column and give a second row next to a literal UNKNOWN.
    """
    named = real_packages(fact).select(
        "ecosystem",
        F.coalesce("license_id", F.lit(ROLLUP_UNKNOWN)).alias("license_id"),
        "repo_full_name",
    )
    # Occurrences per repository first: the distinct count is then a plain count, and
    # one licence with a third of the rows shrinks to its repositories map-side.
    return (
        named.groupBy("ecosystem", "license_id", "repo_full_name")
        .agg(F.count("*").alias("n"))
        .groupBy("ecosystem", "license_id")
        .agg(F.count("*").alias("repo_count"), F.sum("n").alias("occurrence_count"))
    )


def repo_rollup(fact: DataFrame) -> DataFrame:
    return fact.groupBy("repo_full_name").agg(
        F.min("org").alias("org"),
        F.min("repo").alias("repo"),
        F.min("repo_url").alias("repo_url"),
        F.max("pushed_at").alias("pushed_at"),
        F.count("*").alias("dep_count"),
    )


def dependencies_by_repo(fact: DataFrame) -> DataFrame:
    return fact.select(
        "repo_full_name",
        "ecosystem",
        "package_name",
        "package_key",
        "version_raw",
        "version_kind",
        "license_id",
    )


def build_stats(fact: DataFrame, top: int = TOP_ECOSYSTEMS) -> DataFrame:
    """One row: rows, repositories, comparable rows and their share, rows per ecosystem and version kind.

    ``ecosystems`` and ``kinds`` are arrays of (name, rows), the largest first, and
    ``top_ecosystems`` the first ``top`` of the ecosystems. They hold what the fact table has of
    either, which is few; the repositories are counted by many tasks.
    """
    per_repo = fact.groupBy("repo_full_name").agg(
        F.count("*").alias("n"), F.count_if("comparable").alias("c")
    )
    stats = per_repo.agg(
        F.sum("n").alias("rows"), F.count("*").alias("repos"), F.sum("c").alias("comparable")
    ).withColumn(
        "comparable_pct",
        F.floor(F.col("comparable") * F.lit(1000.0) / F.greatest("rows", F.lit(1)) + F.lit(0.5))
        / F.lit(10.0),
    )
    found = stats.withColumns({"ecosystems": _per_name(fact, "ecosystem").scalar(), "kinds": _per_name(fact, "version_kind").scalar()})
    return found.withColumn("top_ecosystems", F.slice("ecosystems", 1, top))


def _per_name(fact: DataFrame, column: str) -> DataFrame:
    """One row: :func:`rows_per` as an array in its order."""
    entry = F.struct((-F.col("rows")).alias("_order"), F.col(column).alias("name"), "rows")
    listed = rows_per(fact, column).agg(F.sort_array(F.collect_list(entry)).alias("listed"))
    return listed.select(F.transform("listed", lambda e: F.struct(e["name"].alias("name"), e["rows"].alias("rows"))))


def rows_per(fact: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Row counts per ecosystem or version kind, the largest first."""
    counted = fact.groupBy(column).agg(F.count("*").alias("rows"))
    return counted if top is None else counted.orderBy(F.desc("rows"), column).limit(top)
