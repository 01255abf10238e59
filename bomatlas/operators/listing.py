"""Ranked lists: popular packages, licences, and the dependencies of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomatlas.operators.ranking import top_per_group
from bomatlas.operators.search import name_contains, size_of

# List sizes where the caller names none.
DEFAULT_TOP = 50
DEFAULT_LISTING = 500


def top_packages(
    popularity: DataFrame,
    ecosystem: str | None = None,
    contains: str | None = None,
    top: int | None = None,
) -> DataFrame:
    if ecosystem:
        popularity = popularity.where(F.col("ecosystem") == ecosystem)
    if contains and contains.strip():
        popularity = name_contains(popularity, contains)
    return popularity.orderBy(F.desc("repo_count"), "package_key", "ecosystem").limit(
        size_of(top, DEFAULT_TOP)
    )


def top_licenses(
    rollup: DataFrame, license_id: str, ecosystem: str | None = None, top: int | None = None
) -> DataFrame:
    rollup = rollup.where(F.col("license_id") == license_id.strip())
    if ecosystem:
        rollup = rollup.where(F.col("ecosystem") == ecosystem)
    return rollup.orderBy(F.desc("repo_count"), "ecosystem").limit(size_of(top, DEFAULT_TOP))


def package_popularity(
    popularity: DataFrame,
    rollup: DataFrame,
    ecosystem: str | None = None,
    license_id: str | None = None,
    top: int | None = None,
    contains: str | None = None,
) -> DataFrame:
    """Licence mode when a licence is given, package mode otherwise."""
    if license_id:
        return top_licenses(rollup, license_id, ecosystem, top)
    return top_packages(popularity, ecosystem, contains, top)


def _listed(by_repo: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` dependencies of each repository, or all of them."""
    columns = ["repo_full_name", "ecosystem", "package_name", "version_raw", "version_kind", "license_id"]
    totals = by_repo.groupBy("repo_full_name").agg(F.count("*").alias("dependency_count"))
    if limit is None:
        complete = {"returned": F.col("dependency_count"), "truncated": F.lit(False)}
        return by_repo.select(*columns).join(totals, "repo_full_name").withColumns(complete)
    order = [F.asc("ecosystem"), F.asc("package_name"), F.asc("version_raw"), F.asc_nulls_first("license_id")]
    listed = top_per_group(by_repo.select(*columns), ["repo_full_name"], order, limit)
    return listed.join(totals, "repo_full_name").withColumns(
        {
            "returned": F.least("dependency_count", F.lit(limit).cast("bigint")),
            "truncated": F.col("dependency_count") > limit,
        }
    )


def repo_dependencies(
    by_repo: DataFrame,
    repos: DataFrame | None = None,
    ecosystem: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Dependencies of the repositories in ``repos`` (all without it), with totals.

    The total is a grouped count joined back, rather than a window that would gather a
    repository's rows in one task.
    """
    if repos is not None:
        by_repo = by_repo.join(repos.select("repo_full_name").distinct(), "repo_full_name", "left_semi")
    if ecosystem:
        by_repo = by_repo.where(F.col("ecosystem") == ecosystem)
    return _listed(by_repo, size_of(limit, DEFAULT_LISTING))


def sbom_source_url(base_url: str, org: Column, repo: Column) -> Column:
    return F.concat(F.lit(base_url.rstrip("/") + "/"), org, F.lit("/"), repo, F.lit(".json.gz"))


def sbom_export(
    by_repo: DataFrame, base_url: str, repos: DataFrame | None = None, limit: int | None = None
) -> DataFrame:
    """Every dependency of each repository (or ``limit`` of them), with the address of the source document."""
    if repos is not None:
        by_repo = by_repo.join(repos.select("repo_full_name").distinct(), "repo_full_name", "left_semi")
    name = F.col("repo_full_name")
    listed = _listed(by_repo, limit if limit is None else size_of(limit, limit))
    return listed.drop("rank").withColumn(
        "sbom_source_url",
        sbom_source_url(
            base_url, F.substring_index(name, "/", 1), F.get(F.split(name, "/"), F.lit(1))
        ),
    )


def counts_by_ecosystem(listed: DataFrame) -> DataFrame:
    """Counts over the rows that were returned, as the export reports them."""
    return listed.groupBy("repo_full_name", "ecosystem").agg(F.count("*").alias("dependencies"))
