"""The daily job: fact partition, summaries of it, and then the served snapshot."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bomatlas.operators import summaries
from bomatlas.sources import tables
from bomatlas.sources.sbom import to_fact


@dataclass(frozen=True)
class DependencyIndex:
    """The stored tables. ``fact`` holds every snapshot, the others the served one."""

    fact: DataFrame
    current: DataFrame
    popularity: DataFrame
    license_rollup: DataFrame
    repos: DataFrame
    by_repo: DataFrame
    date: str
    stats: dict[str, int] | None = None


_SUMMARIES = {
    "pkg_popularity": summaries.pkg_popularity,
    "license_rollup": summaries.license_rollup,
    "repos": summaries.repo_rollup,
}


def fact_path(base: str) -> str:
    return f"{base}/dependencies"


def _summary_path(base: str, name: str, date: str) -> str:
    return f"{base}/{name}/{date}"


def publish(
    spark: SparkSession,
    libraries: DataFrame,
    ingested_date: Column,
    base: str,
    date: str,
    files: int | None = None,
    dates: tables.Dates | None = None,
) -> DependencyIndex:
    """Store the snapshots of exploded ``libraries`` and serve the one of ``date``.

    ``stats`` of the result counts the rows while they are written, without a further scan.
    ``dates`` (see :func:`tables.dates_at_once`) has the snapshots dealt and written some at a
    time, ``files`` for each group; all together without it.
    """
    stats = {"rows": 0, "comparable": 0}
    for group in [None] if dates is None else dates:
        counted = Observation()
        some = libraries if group is None else tables.of_dates(libraries, ingested_date, group)
        fact = to_fact(some, ingested_date, layout=lambda rows: tables.ranged(rows, files)).observe(
            counted, F.count("*").alias("rows"), F.count_if("comparable").alias("comparable")
        )
        tables.write_snapshot(fact, fact_path(base), laid_out=True)
        stats = {name: n + counted.get[name] for name, n in stats.items()}
    build_summaries(spark, base, date, files)
    tables.serve(spark, base, date)
    return replace(open_index(spark, base), stats=stats)


def build_summaries(spark: SparkSession, base: str, date: str, files: int | None = None) -> None:
    """The summaries of one stored snapshot, beside those of other dates; safe to repeat."""
    stored = tables.snapshot(spark, fact_path(base), date)
    for name, build in _SUMMARIES.items():
        build(stored).write.mode("overwrite").option("compression", "zstd").parquet(_summary_path(base, name, date))
    listing = stored.select(
        *summaries.dependencies_by_repo(stored).columns, "version_sort_key", "is_prerelease"
    )
    tables.clustered_by_repo(listing, files).write.mode("overwrite").option("compression", "zstd").parquet(
        _summary_path(base, "dependencies_by_repo", date)
    )


def open_index(spark: SparkSession, base: str, date: str | None = None) -> DependencyIndex:
    """The stored tables as frames, of ``date`` or of the snapshot served last."""
    date = date or tables.served_date(spark, base)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(_summary_path(base, name, date))

    return DependencyIndex(
        fact=tables.read_fact(spark, fact_path(base)),
        current=tables.snapshot(spark, fact_path(base), date),
        popularity=read("pkg_popularity"),
        license_rollup=read("license_rollup"),
        repos=read("repos"),
        by_repo=read("dependencies_by_repo"),
        date=date,
    )
