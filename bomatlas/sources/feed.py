"""The repository feed: which repositories exist and when they last changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomatlas.functions.text import blank_to_null

FEED_SCHEMA = "owner string, org string, name string, pushedAt string, url string"
RAW_FEED_SCHEMA = "html_url string, pushed_at string, full_name string"


def read_feed(spark: SparkSession, path: str, schema: str = FEED_SCHEMA) -> DataFrame:
    """JSON arrays of repositories with their ``position``: the file's name, then the place in it.

    A file is read by one task, so places rise along it; which task reads which file does
    not matter. Later files, by name, come after earlier ones.
    """
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .json(path)
        .withColumn("position", F.struct("_metadata.file_path", F.monotonically_increasing_id().alias("at")))
    )


def normalise_feed(feed: DataFrame) -> DataFrame:
    """(repo_key, full_name, pushed_at, repo_url), one row per key; the last entry wins.

    ``max`` over a struct led by the position keeps the last entry without collecting
    or sorting a group.
    """
    owner = F.coalesce(blank_to_null(F.col("owner")), blank_to_null(F.col("org")))
    named = feed.withColumns({"_owner": owner, "_name": blank_to_null(F.col("name"))}).where(
        F.col("_owner").isNotNull() & F.col("_name").isNotNull()
    )
    full = F.concat("_owner", F.lit("/"), "_name")
    last = (
        named.select(
            F.lower(full).alias("repo_key"),
            F.struct(
                F.col("position"),
                full.alias("full_name"),
                F.try_to_timestamp(blank_to_null(F.col("pushedAt"))).alias("pushed_at"),
                F.coalesce(
                    blank_to_null(F.col("url")), F.concat(F.lit("https://github.com/"), full)
                ).alias("repo_url"),
            ).alias("entry"),
        )
        .groupBy("repo_key")
        .agg(F.max("entry").alias("entry"))
    )
    return last.select("repo_key", "entry.full_name", "entry.pushed_at", "entry.repo_url")


def is_valid_entry(html_url: Column, pushed_at: Column, full_name: Column) -> Column:
    """A usable feed row has a URL, a push time and an ``org/name``."""
    return F.coalesce(
        (html_url != "") & (pushed_at != "") & full_name.rlike(r"^[^/]+/[^/]+$"), F.lit(False)
    )


def valid_entries(feed: DataFrame) -> DataFrame:
    return feed.where(
        is_valid_entry(F.col("html_url"), F.col("pushed_at"), F.col("full_name"))
    ).select(
        F.col("html_url").alias("url"),
        F.col("pushed_at").alias("pushedAt"),
        F.substring_index("full_name", "/", 1).alias("org"),
        F.substring_index("full_name", "/", -1).alias("name"),
    )


def validation_stats(feed: DataFrame) -> DataFrame:
    ok = is_valid_entry(F.col("html_url"), F.col("pushed_at"), F.col("full_name"))
    return feed.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid")
    )
