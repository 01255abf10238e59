"""Writing the index: partition replacement, layouts, retention and the served snapshot."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomatlas.sources.sbom import FACT_COLUMNS

# Fixed value: days of snapshots that are kept.
RETENTION_DAYS = 90

_TYPES = {
    "pushed_at": T.TimestampType(),
    "comparable": T.BooleanType(),
    "exact_scheme": T.BooleanType(),
    "epoch": T.LongType(),
    "is_prerelease": T.BooleanType(),
    "is_self_ref": T.BooleanType(),
    "is_action": T.BooleanType(),
    "ingested_date": T.DateType(),
}
_NULLABLE = {"repo_url", "pushed_at", "version_raw", "version_sort_key", "license_id"}

FACT_SCHEMA = T.StructType(
    [T.StructField(c, _TYPES.get(c, T.StringType()), c in _NULLABLE) for c in FACT_COLUMNS]
)


def enforce_schema(fact: DataFrame) -> DataFrame:
    """Exactly the 20 columns with their types; a NULL in a required one fails the job."""
    extra = set(fact.columns) - set(FACT_COLUMNS)
    missing = set(FACT_COLUMNS) - set(fact.columns)
    if extra or missing:
        raise ValueError(f"unknown columns {sorted(extra)}, missing columns {sorted(missing)}")
    given = {field.name: field.dataType for field in fact.schema}
    required = [F.col(field.name).isNotNull() for field in FACT_SCHEMA if not field.nullable]
    complete = reduce(lambda a, b: a & b, required)
    problem = F.raise_error(F.lit("NULL in a required column of the fact table"))
    return fact.select(
        *[
            F.col(f.name) if given[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name)
            for f in FACT_SCHEMA
        ]
    ).where(F.when(complete, F.lit(True)).otherwise(problem.cast("boolean")))


_CLUSTER = ["ingested_date", "ecosystem", "package_key", "repo_full_name"]
# Rows of one file at most; a range larger than that is written as several files.
ROWS_PER_FILE = 5_000_000


def ranged(rows: DataFrame, files: int | None = None) -> DataFrame:
    """Rows dealt by snapshot and package, so min/max statistics prune package reads.

    The repository is part of the range key: a package with a third of all rows is spread
    over as many ranges as its share asks for. ``files`` is their number, the session's
    shuffle partitions without it; choose it by the bytes of a snapshot.
    """
    return rows.repartitionByRange(*([files] if files else []), *_CLUSTER)


def clustered(rows: DataFrame, files: int | None = None) -> DataFrame:
    """:func:`ranged` rows, sorted inside each range."""
    return ranged(rows, files).sortWithinPartitions(*_CLUSTER)


def clustered_by_repo(by_repo: DataFrame, files: int | None = None) -> DataFrame:
    order = ["repo_full_name", "ecosystem", "package_name"]
    return by_repo.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)


#: Rows of snapshots that are dealt together. A larger snapshot is dealt by itself.
ROWS_AT_ONCE = 20_000_000
#: Groups of snapshots that are dealt and written one after the other.
Dates = list[list[dt.date | None]]


def dates_at_once(rows: DataFrame, most: int | None = None, size: Column | None = None) -> Dates:
    """The dates in ``rows``, in groups of ``most`` rows (or other ``size``) or of one larger date.

    What is on disk while rows are dealt is that of one group. None stands for rows without a
    date, which a table may refuse.
    """
    most = most or ROWS_AT_ONCE
    sizes = rows.groupBy("ingested_date").agg(F.count("*") if size is None else size).collect()
    groups: Dates = []
    room = -1
    for date, n in sorted(sizes, key=lambda r: (r[0] is not None, r[0] or dt.date.min)):
        if n > room:
            groups.append([])
            room = most
        groups[-1].append(date)
        room -= n
    return groups


def of_dates(rows: DataFrame, column: Column, dates: list[dt.date | None]) -> DataFrame:
    """The rows of these dates; None stands for rows without a date."""
    found = column.isin([d for d in dates if d is not None])
    return rows.where(found | column.isNull() if None in dates else found)


def write_snapshot(fact: DataFrame, path: str, laid_out: bool = False, dates: Dates | None = None) -> None:
    """Replace exactly the date partitions that occur in ``fact``; running twice is safe.

    ``laid_out`` says that the rows are dealt by range already. They are sorted here, after
    the last step that could lose their order; the sort begins with the partition column,
    so the writer needs none of its own. With ``dates`` each group of them is dealt and
    written before the next; a group's partitions are replaced together.
    """
    if dates is not None:
        for group in dates:
            write_snapshot(of_dates(fact, F.col("ingested_date"), group), path, laid_out)
        return
    checked = enforce_schema(fact)
    (
        (checked if laid_out else ranged(checked))
        .sortWithinPartitions(*_CLUSTER)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .option("compression", "zstd")
        .partitionBy("ingested_date")
        .parquet(path)
    )


def read_fact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACT_SCHEMA).parquet(path)


def write_ndjson(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("compression", "gzip").json(path)


def retained(fact: DataFrame, latest: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows of snapshots not older than ``days`` before ``latest``; prunes partitions."""
    bound = F.date_sub(F.to_date(F.lit(latest)), days)
    return fact.where(F.col("ingested_date") >= bound)


def drop_expired(spark: SparkSession, path: str, latest: str, days: int = RETENTION_DAYS) -> list[str]:
    """Delete the partition folders of expired snapshots; returns their dates.

    Works on folder names alone, so no data is read.
    """
    oldest = dt.date.fromisoformat(latest) - dt.timedelta(days=days)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("ingested_date="):
            date = name.split("=", 1)[1]
            if dt.date.fromisoformat(date) < oldest:
                fs.delete(status.getPath(), True)
                dropped.append(date)
    return sorted(dropped)


def snapshot(spark: SparkSession, path: str, date: str) -> DataFrame:
    """One snapshot. The date is a literal, so the scan lists one partition only."""
    return read_fact(spark, path).where(F.col("ingested_date") == F.to_date(F.lit(date)))


_SERVED_SCHEMA = "date string, served_at timestamp"


def _served_path(base: str) -> str:
    return f"{base}/served"


def serve(spark: SparkSession, base: str, date: str) -> None:
    """Make ``date`` the snapshot that readers of the index at ``base`` see from now on.

    One row is appended to a small table, as the last step of a job. A commit is whole or
    absent, so a job that dies before leaves the date served so far.
    """
    row = spark.range(1).select(F.lit(date).alias("date"), F.current_timestamp().alias("served_at"))
    row.coalesce(1).write.mode("append").parquet(_served_path(base))


def served_date(spark: SparkSession, base: str) -> str:
    """The date of the last :func:`serve`, in whatever session it was called."""
    last = spark.read.schema(_SERVED_SCHEMA).parquet(_served_path(base)).agg(F.max_by("date", "served_at")).first()[0]
    if last is None:
        raise ValueError(f"nothing is served at {base}")
    return last
