"""Which versions in use are exposed to known advisories, per package, repository or org."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomatlas.operators.intervals import covered_ranks, merged, point_nodes, span_nodes
from bomatlas.operators.ranking import top_per_group
from bomatlas.operators.search import concrete, known_ecosystem, of_org, of_package
from bomatlas.session import run_path
from bomatlas.sources.refdata import advisory_details, affected_ranges, affected_versions

# List sizes of a report where the caller names none.
SAMPLE_REPOS = 25
REPORT_FINDINGS = 200
#: Spans of a package that its versions are compared with one by one.
DIRECT_SPANS = 64
#: Advisories, on average, that a version meets at once where one place holds more.
SPANS_AT_ONCE = 500

IDENTITY = ["ecosystem", "package_key", "version_raw"]
#: What versions and advisories meet by.
PLACE = ["ecosystem", "package_key", "_level", "_node", "_slice"]


def org_of(repo_full_name: str = "repo_full_name"):
    return F.substring_index(repo_full_name, "/", 1)


def scope(fact: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Concrete versions in use with the number of repositories that have them.

    ``by`` adds scope columns: none for packages, ``["org"]`` or ``["repo_full_name"]``.
    """
    by = by or []
    return (
        concrete(fact)
        .groupBy(*by, *IDENTITY)
        .agg(
            F.min("package_name").alias("package_name"),
            F.max("version_sort_key").alias("version_sort_key"),
            F.count_distinct("repo_full_name").alias("n")
            if "repo_full_name" not in by
            else F.lit(1).cast("bigint").alias("n"),
        )
    )


def sample_repos(fact: DataFrame, by: list[str] | None = None, names: int = SAMPLE_REPOS) -> DataFrame:
    """Up to ``names`` repositories per scope row, the first by name.

    They are ranked first and only then collected, so an array holds so many at most.
    """
    keys = [*(by or []), *IDENTITY]
    pairs = concrete(fact).select(*keys, "repo_full_name").distinct()
    return (
        top_per_group(pairs, keys, [F.col("repo_full_name")], names)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("repo_full_name")).alias("repos_sample"))
    )


def identities(scoped: DataFrame) -> DataFrame:
    """Distinct (ecosystem, package, version) to look up."""
    return scoped.select(*IDENTITY, "version_sort_key").distinct()


def _places(ids: DataFrame, advisories: DataFrame, direct: int = DIRECT_SPANS) -> tuple[DataFrame, DataFrame]:
    """``IDENTITY`` with ``_rank``, and the package and ``id`` with each place that an advisory covers, ``_level, _node``.

    A version (of one sort key, the largest, if repeats differ) and an advisory share one place
    if the one affects the other, else none. An advisory's ranges and listed versions become the
    ranks they cover, and ranks covered twice count once.

    A package of up to ``direct`` different spans compares each version with each of them; of
    packages with more, the ranks come from one order of versions and bounds.
    """
    package = ["ecosystem", "package_key"]
    key, bounds = "version_sort_key", ["introduced_key", "fixed_key", "last_affected_key"]
    # Some rows for each advisory, and the ranked versions: both are read several times below.
    ranges = _written(affected_ranges(advisories).select("id", *package, *bounds).distinct(), "spans")
    order = Window.partitionBy(*package).orderBy(F.col(key).asc_nulls_last(), "version_raw")
    ranked = ids.groupBy(*IDENTITY).agg(F.max(key).alias(key)).withColumn("_rank", (F.row_number().over(order) - 1).cast("bigint"))
    points = _written(ranked, "points")
    keyed, shapes = points.where(F.col(key).isNotNull()), ranges.drop("id").distinct()
    crowded = shapes.groupBy(*package).agg(F.count("*").alias("n")).where(F.col("n") > direct).select(*package)
    some = not crowded.isEmpty()
    few = shapes.join(crowded, package, "left_anti") if some else shapes
    low, below, upto = (F.col(b) for b in bounds)
    held = (
        keyed.join(few, package)
        .where(
            (low.isNull() | (F.col(key) >= low)) & (below.isNull() | (F.col(key) < below)) & (upto.isNull() | (F.col(key) <= upto))
        )
        .groupBy(*package, *bounds)
        .agg(F.min("_rank").alias("_from"), (F.max("_rank") + 1).alias("_to"))
    )
    if some:
        held = held.unionByName(
            covered_ranks(keyed.join(crowded, package, "left_semi"), shapes.join(crowded, package, "left_semi"), package, key, *bounds)
        )
    held = held.withColumnsRenamed({c: f"_{c}" for c in [*package, *bounds]})
    same = [F.col(c) == F.col(f"_{c}") for c in package] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in bounds]
    covered = ranges.join(held, same).select(*package, "id", "_from", "_to")
    listed = affected_versions(advisories).join(points, IDENTITY).select(*package, "id", F.col("_rank").alias("_from"), (F.col("_rank") + 1).alias("_to"))
    return points, _written(span_nodes(merged(covered.unionByName(listed), [*package, "id"])), "nodes")


def meetings(ids: DataFrame, advisories: DataFrame, direct: int = DIRECT_SPANS) -> tuple[DataFrame, DataFrame]:
    """Where versions and advisories meet: ``IDENTITY`` and the package with ``id``, each beside ``_level, _node, _slice``.

    An equi join by these makes each pair once and nothing need be told apart after it. Of a
    place that many advisories cover, each slice has ``SPANS_AT_ONCE`` of them at a time, and
    each version stands in all slices.
    """
    package = ["ecosystem", "package_key"]
    points, nodes = _places(ids, advisories, direct)
    place = [*package, "_level", "_node"]
    slices = nodes.groupBy(*place).agg(F.ceil(F.count("*") / SPANS_AT_ONCE).cast("int").alias("_slices"))
    every = F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("_slice")
    versions = point_nodes(points, package).join(slices, place).select(*IDENTITY, "_level", "_node", every)
    spans = nodes.join(slices, place).select(*place, "id", F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int").alias("_slice"))
    return versions, spans


def _written(frame: DataFrame, name: str) -> DataFrame:
    path = run_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _met(versions: DataFrame, spans: DataFrame) -> DataFrame:
    """Both sides where they share a place. It makes more rows than it reads, so its tasks are not merged by what they read."""
    tasks = int(versions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return versions.repartition(tasks, *PLACE).join(spans.repartition(tasks, *PLACE), PLACE)


def exposed(ids: DataFrame, advisories: DataFrame, direct: int = DIRECT_SPANS) -> DataFrame:
    """(ecosystem, package_key, version_raw, id): exact listings and introduced/fixed ranges.

    All joins are equi joins over distinct versions; rows of the fact table never meet the
    advisories, so a package with a third of all rows costs no more than its number of
    versions.
    """
    return _met(*meetings(ids, advisories, direct)).select(*IDENTITY, "id")


def advisory_counts(ids: DataFrame, advisories: DataFrame, direct: int = DIRECT_SPANS) -> DataFrame:
    """``IDENTITY, advisory_count, first_id``: :func:`exposed` counted per version, with its smallest id.

    A version and an advisory share one place at most, so advisories are counted per place and
    a version adds up its few places; no pair is made, which are many where a package has many
    versions and many advisories.
    """
    place = ["ecosystem", "package_key", "_level", "_node"]
    points, nodes = _places(ids, advisories, direct)
    held = nodes.groupBy(*place).agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    return (
        point_nodes(points, place[:2])
        .join(held, place)
        .groupBy(*IDENTITY)
        .agg(F.sum("_n").alias("advisory_count"), F.min("_first").alias("first_id"))
    )


def findings(fact: DataFrame, advisories: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per (scope row, advisory) with the advisory's details.

    Findings may be many more than scope rows and advisories; each is made by the last join,
    and none moves after it.
    """
    scoped = scope(fact, by)
    versions, spans = meetings(identities(scoped), advisories)
    return (
        _met(scoped.join(versions, IDENTITY), spans.join(advisory_details(advisories), "id"))
        .select(
            *(by or []),
            "ecosystem",
            "package_key",
            F.col("package_name").alias("package"),
            F.col("version_raw").alias("version"),
            F.col("n").alias("affected_repo_count"),
            "id",
            "cve",
            "severity",
            "summary",
            "url",
        )
    )


def exposure_report(
    fact: DataFrame,
    advisories: DataFrame,
    by: list[str] | None = None,
    limit: int = REPORT_FINDINGS,
    names: int = SAMPLE_REPOS,
) -> DataFrame:
    """The first ``limit`` findings per scope, most repositories first, with sampled names.

    ``vulnerable_versions`` counts all findings of the scope, before the cut. Names are
    sampled for the findings shown only.
    """
    by = by or []
    scoped = scope(fact, by)
    hits = advisory_counts(identities(scoped), advisories)
    vulnerable = scoped.join(hits, IDENTITY).drop("version_sort_key")
    order = [F.desc("n"), F.asc("ecosystem"), F.asc("package_key"), F.asc("version_raw")]
    if by:
        totals = vulnerable.groupBy(*by).agg(F.count("*").alias("vulnerable_versions"))
        shown = top_per_group(vulnerable, by, order, limit).drop("rank").join(totals, by)
    else:
        total = vulnerable.agg(F.count("*")).scalar()
        shown = vulnerable.orderBy(*order).limit(limit).withColumn("vulnerable_versions", total)
    of_shown = fact.join(shown.select(*by, *IDENTITY), [*by, *IDENTITY], "left_semi")
    return shown.join(sample_repos(of_shown, by, names), [*by, *IDENTITY]).withColumnRenamed(
        "n", "affected_repo_count"
    )


def vulnerability_exposure(
    fact: DataFrame,
    by_repo: DataFrame,
    advisories: DataFrame,
    package: str | None = None,
    ecosystem: str | None = None,
    repo_full_name: str | None = None,
    org: str | None = None,
) -> DataFrame:
    """The report for one scope: package, else repository, else organisation.

    ``by_repo`` needs ``version_sort_key`` next to the listing columns.
    """
    if package:
        if not ecosystem:
            raise ValueError("name the package's ecosystem as well")
        return exposure_report(of_package(fact, known_ecosystem(ecosystem), package), advisories)
    if repo_full_name:
        rows = by_repo.where(F.col("repo_full_name") == repo_full_name)
        return exposure_report(rows, advisories)
    if org:
        return exposure_report(of_org(by_repo, org), advisories)
    raise ValueError("choose a scope: package, repository or organisation")
