"""Technology profile of organisations. All parts answer for every org in the input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomatlas.functions.licences import is_copyleft
from bomatlas.operators.eol import eol_status
from bomatlas.operators.exposure import org_of
from bomatlas.operators.ranking import top_per_group
from bomatlas.operators.search import of_org
from bomatlas.operators.summaries import LANDSCAPE_NONE
from bomatlas.sources.refdata import eol_product

# List sizes of a profile.
TOP_PACKAGES = 25
TOP_LICENCES = 8
UNKNOWN_LICENCES = (LANDSCAPE_NONE, "NOASSERTION")


def _with_org(by_repo: DataFrame) -> DataFrame:
    return by_repo.withColumn("org", org_of())


def org_ecosystems(by_repo: DataFrame) -> DataFrame:
    """Repositories and dependencies per ecosystem.

    Counted per repository first, so the distinct count needs no second copy of the rows.
    """
    return (
        _with_org(by_repo)
        .groupBy("org", "ecosystem", "repo_full_name")
        .agg(F.count("*").alias("n"))
        .groupBy("org", "ecosystem")
        .agg(F.count("*").alias("repos"), F.sum("n").alias("dependencies"))
    )


def org_repo_count(by_repo: DataFrame) -> DataFrame:
    """Distinct repositories; not the sum over ecosystems, which a repository can span."""
    return _with_org(by_repo).groupBy("org").agg(F.count_distinct("repo_full_name").alias("repo_count"))


def org_top_packages(by_repo: DataFrame) -> DataFrame:
    counted = (
        _with_org(by_repo.where(~F.col("ecosystem").isin("github", "githubactions")))
        .groupBy("org", "ecosystem", "package_name")
        .agg(F.count_distinct("repo_full_name").alias("repos"))
    )
    return top_per_group(
        counted, ["org"], [F.desc("repos"), F.asc("ecosystem"), F.asc("package_name")], TOP_PACKAGES
    )


def _licence_counts(by_repo: DataFrame) -> DataFrame:
    return (
        _with_org(by_repo)
        .groupBy("org", F.coalesce("license_id", F.lit(LANDSCAPE_NONE)).alias("licence"))
        .agg(F.count("*").alias("occurrences"))
    )


def org_licence_summary(by_repo: DataFrame) -> DataFrame:
    unknown = F.col("licence").isin(*UNKNOWN_LICENCES)
    copyleft = ~unknown & is_copyleft(F.col("licence"))
    return (
        _licence_counts(by_repo)
        .groupBy("org")
        .agg(
            F.sum(F.when(copyleft, F.col("occurrences")).otherwise(0)).alias("copyleft_occurrences"),
            F.sum(F.when(unknown, F.col("occurrences")).otherwise(0)).alias("unknown_or_missing"),
        )
    )


def org_top_licences(by_repo: DataFrame) -> DataFrame:
    return top_per_group(
        _licence_counts(by_repo), ["org"], [F.desc("occurrences"), F.asc("licence")], TOP_LICENCES
    )


def org_eol_frameworks(by_repo: DataFrame, cycles: DataFrame, as_of: Column) -> DataFrame:
    """Framework releases past end of life, with the repositories that have them."""
    used = (
        _with_org(
            by_repo.where(
                (F.col("version_kind") == "release")
                & eol_product(F.col("ecosystem"), F.col("package_key")).isNotNull()
            )
        )
        .groupBy("org", "ecosystem", "package_key", "version_raw")
        .agg(
            F.min("package_name").alias("package"), F.count_distinct("repo_full_name").alias("repos")
        )
    )
    return (
        eol_status(used, cycles, as_of)
        .where("is_eol")
        .select(
            "org",
            "package",
            F.col("version_raw").alias("version"),
            "repos",
            F.col("eol").alias("eol_date"),
            "product",
        )
    )


def dependency_landscape(
    by_repo: DataFrame, org: str, cycles: DataFrame, as_of: Column
) -> dict[str, DataFrame]:
    """The five parts of one organisation's profile."""
    rows = of_org(by_repo, org)
    return {
        "repo_count": org_repo_count(rows),
        "ecosystems": org_ecosystems(rows).orderBy(F.desc("dependencies"), "ecosystem"),
        "top_packages": org_top_packages(rows).orderBy("rank"),
        "licence_summary": org_licence_summary(rows),
        "top_licences": org_top_licences(rows).orderBy("rank"),
        "eol_frameworks": org_eol_frameworks(rows, cycles, as_of).orderBy(
            F.desc("repos"), "package", "version"
        ),
    }
