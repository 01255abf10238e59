"""Which repositories use a package, kept per snapshot as mergeable sets of numbers.

Counting distinct repositories over several snapshots, or over all packages, reads every fact
again each time. Here each repository has a number, given once; a snapshot adds one partition
that holds, for each package, the numbers of its repositories: in blocks of 32,768 numbers, as a
list where a block has few of them and as a bitmap otherwise. Blocks don't overlap, so their
counts add up, and sets of other dates or packages merge without a look at the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = ["ecosystem", "package_key"]
#: A block with more numbers than this is a bitmap (4 KB), one with fewer a list.
LIST_MOST = 256
#: Numbers of one bitmap, as Spark's bitmap functions have them.
BLOCK = 32_768
_NUMBERS = "repo_full_name string, number bigint"
_SETS = "ecosystem string, package_key string, block bigint, repo_count bigint, spots array<int>, bits binary, ingested_date date"


def _numbers_path(base: str) -> str:
    return f"{base}/numbers"


def _sets_path(base: str) -> str:
    return f"{base}/sets"


def create(spark: SparkSession, base: str) -> None:
    """An empty store in a new folder."""
    spark.createDataFrame([], _NUMBERS).write.parquet(_numbers_path(base))
    spark.createDataFrame([], _SETS).write.partitionBy("ingested_date").parquet(_sets_path(base))


def numbers(spark: SparkSession, base: str) -> DataFrame:
    """``repo_full_name, number``. Should two writers have named a repository, its smallest number counts."""
    return spark.read.schema(_NUMBERS).parquet(_numbers_path(base)).groupBy("repo_full_name").agg(F.min("number").alias("number"))


def _number_new(spark: SparkSession, base: str, fact: DataFrame) -> None:
    """Give repositories that have no number one above all that are given; each writing task counts on its own.

    A task that runs again gives its names other numbers of its range, and only one of its
    attempts is committed; numbers once written never change.
    """
    last = spark.read.schema(_NUMBERS).parquet(_numbers_path(base)).agg(F.max("number")).first()[0]
    start = 0 if last is None else (last // BLOCK + 1) * BLOCK
    new = fact.select("repo_full_name").distinct().join(numbers(spark, base), "repo_full_name", "left_anti")
    new.select("repo_full_name", (F.monotonically_increasing_id() + start).alias("number")).write.mode("append").parquet(_numbers_path(base))


def _packed(spots: DataFrame, keys: list[str], list_most: int) -> DataFrame:
    """Sets from distinct ``keys, block, spot``: a list is at most a block long, and the second grouping needs no shuffle."""
    lists = spots.groupBy(*keys, "block").agg(F.count("*").alias("repo_count"), F.collect_list("spot").alias("spots"))
    few = F.col("repo_count") <= list_most
    small = lists.where(few).select(*keys, "block", "repo_count", F.sort_array("spots").alias("spots"), F.lit(None).cast("binary").alias("bits"))
    large = (
        lists.where(~few)
        .select(*keys, "block", F.explode("spots").alias("spot"))
        .groupBy(*keys, "block")
        .agg(F.count("*").alias("repo_count"), F.bitmap_construct_agg(F.col("spot").cast("bigint")).alias("bits"))
        .select(*keys, "block", "repo_count", F.lit(None).cast("array<int>").alias("spots"), "bits")
    )
    return small.unionByName(large)


def add_snapshots(spark: SparkSession, base: str, fact: DataFrame, list_most: int = LIST_MOST) -> None:
    """File the snapshots in ``fact``; replaces exactly the dates that occur in it, so it may run again.

    Rows without a repository, package or date count nowhere. Other dates are neither read nor
    written. Repeated rows count once.
    """
    known = fact.select(*PACKAGE, "ingested_date", "repo_full_name").dropna().distinct()
    _number_new(spark, base, known)
    numbered = known.join(numbers(spark, base), "repo_full_name")
    spots = numbered.select(
        *PACKAGE, "ingested_date", F.floor(F.col("number") / BLOCK).alias("block"), F.pmod("number", F.lit(BLOCK)).cast("int").alias("spot")
    )
    (
        _packed(spots, [*PACKAGE, "ingested_date"], list_most)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("ingested_date")
        .parquet(_sets_path(base))
    )


def read(spark: SparkSession, base: str) -> DataFrame:
    """The stored sets; a filter on ``ingested_date`` prunes partitions."""
    return spark.read.schema(_SETS).parquet(_sets_path(base))


def snapshots(sets: DataFrame) -> DataFrame:
    """Distinct repositories per package and snapshot date, from the counts alone: bitmaps are not read."""
    return sets.groupBy(*PACKAGE, "ingested_date").agg(F.sum("repo_count").alias("repo_count"))


def _unset(spots: Column, bits: Column) -> Column:
    """How many of ``spots`` have no bit in ``bits``."""

    def is_set(spot: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, (spot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, (spot % 8).cast("int")) == 1

    return F.size(F.filter(spots, lambda spot: ~is_set(spot)))


def distinct_repos(sets: DataFrame, keys: list[str], list_most: int = LIST_MOST) -> DataFrame:
    """``keys, repo_count``: repositories in any of the sets with these keys, each counted once.

    ``keys`` are some of the sets' columns, none for one overall row: ``["ingested_date"]`` gives
    the repositories of each snapshot, :data:`PACKAGE` those of a package over all dates read.
    Lists merge by their numbers, bitmaps by their bits, both combined in each task first; at
    most one of each meet per block. No sets, no rows; without keys, a zero.
    """
    lists = sets.where("bits is null").select(*keys, "block", F.explode("spots").alias("spot")).distinct()
    merged = sets.where("bits is not null").groupBy(*keys, "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = (
        _packed(lists, keys, list_most)
        .select(*keys, "block", "spots", F.col("bits"))
        .unionByName(merged.select(*keys, "block", F.lit(None).cast("array<int>").alias("spots"), "bits"))
        .groupBy(*keys, "block")
        .agg(F.max("spots").alias("spots"), F.bitmap_or_agg("bits").alias("bits"))
    )
    none_set = F.bitmap_count("bits") == 0
    count = F.when(F.col("spots").isNull(), F.bitmap_count("bits")).otherwise(
        F.bitmap_count("bits") + F.when(none_set, F.size("spots")).otherwise(_unset(F.col("spots"), F.col("bits")))
    )
    return both.groupBy(*keys).agg(F.coalesce(F.sum(count), F.lit(0)).cast("bigint").alias("repo_count"))
