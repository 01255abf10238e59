"""Who depends on a package, and in which versions.

Every function answers for a whole frame of packages at once. ``watch`` frames carry
(ecosystem, package_key, version_range, include_prereleases).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomatlas.functions.purl import KNOWN_ECOSYSTEMS, package_key_text, package_keys_any_ecosystem
from bomatlas.functions.ranges import parse_version_range, range_comparators, satisfies, satisfies_all
from bomatlas.functions.versions import EXACT_SCHEMES
from bomatlas.operators.ranking import top_per_group

# Page and list sizes where the caller names none.
DEFAULT_PAGE = 200
TOP_VERSIONS = 10

PACKAGE = ["ecosystem", "package_key"]


def size_of(value: int | None, default: int, least: int = 1) -> int:
    """The caller's own number, whatever its size; one that makes no sense is an error."""
    number = default if value is None else int(value)
    if number < least:
        raise ValueError(f"a size or offset of {number} is below {least}")
    return number


def known_ecosystem(name: str) -> str:
    name = name.strip().lower()
    if name not in KNOWN_ECOSYSTEMS:
        raise ValueError(f"unknown ecosystem {name!r}")
    return name


def of_package(fact: DataFrame, ecosystem: str, package: str) -> DataFrame:
    """Rows of one package: two equalities that reach the Parquet scan."""
    return fact.where(
        (F.col("ecosystem") == ecosystem)
        & (F.col("package_key") == package_key_text(ecosystem, package))
    )


def of_packages(fact: DataFrame, packages: DataFrame) -> DataFrame:
    """Rows of the packages listed in a frame (ecosystem, package_key)."""
    return fact.join(packages.select(*PACKAGE).distinct(), PACKAGE, "left_semi")


def of_org(by_repo: DataFrame, org: str) -> DataFrame:
    """Rows of one organisation: a prefix predicate that reaches the Parquet scan."""
    return by_repo.where(F.startswith(F.col("repo_full_name"), F.lit(f"{org}/")))


def name_contains(popularity: DataFrame, text: str) -> DataFrame:
    return popularity.where(
        F.contains(F.lower("package_key"), F.lit(text.strip().lower()))
    )


def concrete(fact: DataFrame) -> DataFrame:
    return fact.where(F.col("version_kind").isin("release", "prerelease"))


def in_range(fact: DataFrame, version_range: str, include_prereleases: bool = False) -> DataFrame:
    """Rows whose version satisfies one literal range; string comparisons on the key."""
    hit = satisfies(F.col("version_sort_key"), parse_version_range(version_range))
    return fact.where(hit if include_prereleases else hit & ~F.col("is_prerelease"))


def _entry() -> Column:
    """Ordered by version, then text; a NULL key comes below every other."""
    return F.struct("version_sort_key", "version_raw", "version_kind")


def representative_versions(fact: DataFrame) -> DataFrame:
    """Per (package, repository): the row with the highest version.

    ``max`` over a struct combines map-side and never gathers a group. Without any
    comparable version the last text in order stands for the repository.
    """
    return (
        fact.groupBy(*PACKAGE, "repo_full_name")
        .agg(F.max(_entry()).alias("e"))
        .select(*PACKAGE, "repo_full_name", "e.version_sort_key", "e.version_raw", "e.version_kind")
    )


def total_repos(fact: DataFrame) -> DataFrame:
    return fact.groupBy(*PACKAGE).agg(F.count_distinct("repo_full_name").alias("total_repo_count"))


def top_versions(fact: DataFrame, limit: int = TOP_VERSIONS) -> DataFrame:
    """Per package the versions most repositories have: (…, version_raw, repos, rank)."""
    counted = fact.groupBy(*PACKAGE, "version_raw").agg(
        F.count_distinct("repo_full_name").alias("repos")
    )
    return top_per_group(counted, PACKAGE, [F.desc("repos"), F.desc("version_raw")], limit)


def _excluded_counts() -> list[Column]:
    kind = F.col("version_kind")
    no_key = F.col("version_sort_key").isNull()
    return [
        F.count_if(no_key & (kind == "range")).alias("declared_range"),
        F.count_if(no_key & (kind == "empty")).alias("empty_version"),
        F.count_if(no_key & ~kind.isin("range", "empty")).alias("other_noncomparable"),
    ]


def excluded_kinds(fact: DataFrame) -> DataFrame:
    """Per package: repositories whose representative version cannot be compared."""
    return representative_versions(fact).groupBy(*PACKAGE).agg(*_excluded_counts())


def _matched(fact: DataFrame, watch: DataFrame) -> DataFrame:
    """Watched rows with ``hit``: does this row's version satisfy the range asked for?

    The watch list is unique per package. Its ranges are parsed once per package, not
    once per fact row.
    """
    asked = watch.select(
        *PACKAGE,
        "version_range",
        F.coalesce("include_prereleases", F.lit(False)).alias("include_prereleases"),
        range_comparators(F.col("version_range")).alias("comparators"),
    )
    return fact.join(asked, PACKAGE).withColumn(
        "hit",
        (F.col("include_prereleases") | ~F.col("is_prerelease"))
        & satisfies_all(F.col("version_sort_key"), F.col("comparators")),
    )


def best_matches(fact: DataFrame, watch: DataFrame) -> DataFrame:
    """Per (package, repository): the highest version inside the range asked for."""
    return (
        _matched(fact, watch)
        .where("hit")
        .groupBy(*PACKAGE, "repo_full_name")
        .agg(F.max(_entry()).alias("e"))
        .select(*PACKAGE, "repo_full_name", "e.version_sort_key", "e.version_raw", "e.version_kind")
    )


def search_summary(fact: DataFrame, watch: DataFrame) -> DataFrame:
    """Per watched package: totals, matched repositories, what was excluded, exactness.

    Every row of the watch list has its answer: a package nobody uses has zeros, and a range
    that cannot be read has ``error`` and no matched count. One pass over the fact table:
    representative and match are two aggregates of the same grouping.
    """
    per_repo = (
        _matched(fact, watch)
        .groupBy(*PACKAGE, "repo_full_name")
        .agg(F.max(_entry()).alias("e"), F.max("hit").alias("hit"))
        .select(*PACKAGE, "hit", "e.*")
    )
    counts = ["total_repo_count", "matched_repo_count", "declared_range", "empty_version", "other_noncomparable"]
    counted = per_repo.groupBy(*PACKAGE).agg(
        F.count("*").alias("total_repo_count"), F.count_if("hit").alias("matched_repo_count"), *_excluded_counts()
    )
    error = F.when(range_comparators(F.col("version_range")).isNull(), "unreadable version range")
    known = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in counts}
    return (
        watch.select(*PACKAGE, "version_range", error.alias("error"))
        .join(counted, PACKAGE, "left")
        .withColumns(known | {"matched_repo_count": F.when(F.col("error").isNull(), known["matched_repo_count"])})
        .withColumn("range_exact", F.col("ecosystem").isin(*EXACT_SCHEMES))
    )


def page_order(collation: str | None = None) -> list[Column]:
    """Highest version first, NULL keys last, then repositories: by code points, or by a collation and then code points."""
    names = [] if collation is None else [F.asc(F.collate("repo_full_name", collation))]
    return [F.desc_nulls_last("version_sort_key"), *names, F.asc("repo_full_name")]


def page(entries: DataFrame, limit: int | None = None, offset: int | None = None, collation: str | None = None) -> DataFrame:
    """One page of repositories per package, highest version first, NULL keys last.

    ``next_offset`` is NULL on the last page. ``collation`` orders the repositories of a version
    as a locale does (``"UNICODE"``), without it they stand in binary order.
    """
    limit, offset = size_of(limit, DEFAULT_PAGE), size_of(offset, 0, 0)
    counts = entries.groupBy(*PACKAGE).agg(F.count("*").alias("entry_count"))
    ranked = top_per_group(
        entries, PACKAGE, page_order(collation), limit, offset
    )
    more = F.col("entry_count") > F.lit(offset + limit)
    slash = F.locate("/", F.col("repo_full_name"))
    return (
        ranked.join(counts, PACKAGE)
        .withColumn("next_offset", F.when(more, F.lit(offset + limit)).cast("bigint"))
        .select(
            *PACKAGE,
            "rank",
            "repo_full_name",
            F.when(slash > 0, F.substring_index("repo_full_name", "/", 1)).otherwise("").alias("org"),
            F.regexp_replace("repo_full_name", r"^[^/]*/", "").alias("repo"),
            F.concat(F.lit("https://github.com/"), "repo_full_name").alias("repo_url"),
            F.col("version_raw").alias("version"),
            "version_kind",
            "next_offset",
        )
    )


def page_one(entries: DataFrame, limit: int | None = None, offset: int | None = None, collation: str | None = None) -> DataFrame:
    """The page of a single package's entries, by Spark's own sort, offset and limit."""
    return (
        entries.orderBy(*page_order(collation))
        .offset(size_of(offset, 0, 0))
        .limit(size_of(limit, DEFAULT_PAGE))
    )


def ecosystem_breakdown(popularity: DataFrame, package: str) -> DataFrame:
    """Repositories per ecosystem that has a package of this name, the most used first."""
    return (
        popularity.where(F.col("package_key").isin(*package_keys_any_ecosystem(package)))
        .select("ecosystem", "package_name", "repo_count")
        .orderBy(F.desc("repo_count"), "ecosystem")
    )


def search_dependency(
    fact: DataFrame,
    popularity: DataFrame,
    package: str,
    ecosystem: str | None = None,
    version_range: str | None = None,
    include_prereleases: bool = False,
    limit: int | None = None,
    offset: int | None = None,
) -> dict[str, DataFrame]:
    """The answer for one package, as named frames.

    Without an ecosystem: ``{"ecosystems": …}``, and a range is refused. Otherwise
    ``summary``, ``top_versions`` and ``repos``.
    """
    if not package.strip():
        raise ValueError("name a package")
    if ecosystem is None:
        if version_range:
            raise ValueError("a range needs the ecosystem its versions belong to")
        return {"ecosystems": ecosystem_breakdown(popularity, package.strip())}
    ecosystem = known_ecosystem(ecosystem)
    rows = of_package(fact, ecosystem, package.strip())
    representative = representative_versions(rows)
    if version_range:
        hits = in_range(rows, version_range, include_prereleases)
        entries = representative_versions(hits)
    else:
        entries = representative
    matched = entries.agg(F.count("*")).scalar()
    summary = representative.agg(
        F.count("*").alias("total_repo_count"), *_excluded_counts()
    ).withColumn("matched_repo_count", matched)
    return {
        "summary": summary.withColumn("range_exact", F.lit(ecosystem in EXACT_SCHEMES)),
        "top_versions": top_versions(rows),
        "repos": page(entries, limit, offset),
    }
