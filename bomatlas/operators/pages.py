"""Pages of a package's repositories from a stored order, at the cost of the page.

:func:`bomatlas.operators.search.page` ranks a package's repositories on every call, so a page
costs as much as all of them. Here the order is written once: rows sorted over all files, numbered
along the way, in blocks of 1,024 numbers with a small table of blocks beside them. A page
begins after a cursor, the sort key and repository of the last row seen, finds its blocks in that
table and reads no others. A cursor stays right when the order is written anew.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bomatlas.operators.search import DEFAULT_PAGE, size_of

PACKAGE = ["ecosystem", "package_key"]
_BITS = 10
#: Rows of a block at most; a package or a file that ends begins another.
BLOCK = 1 << _BITS


@dataclass(frozen=True)
class Cursor:
    """The last row of a page: its sort key, None where it has none, and its repository."""

    version_sort_key: str | None
    repo_full_name: str


def _order() -> list[Column]:
    return [*[F.col(c) for c in PACKAGE], F.desc_nulls_last("version_sort_key"), F.asc("repo_full_name")]


def write_order(entries: DataFrame, path: str, files: int | None = None) -> None:
    """Write ``entries``, one row per (package, repository), in page order to a new folder.

    Rows are dealt by ranges of the whole order, so a package with a third of all rows is spread
    over many files. ``files`` is their number, the session's shuffle partitions without it.
    """
    order = _order()
    ordered = entries.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order)
    numbered = ordered.withColumn("position", F.monotonically_increasing_id())
    # Parquet prunes by pages of a row group, which here are as fine as blocks.
    numbered.write.option("parquet.page.row.count.limit", str(BLOCK)).parquet(f"{path}/rows")
    stored = entries.sparkSession.read.schema(numbered.schema).parquet(f"{path}/rows")
    last = F.max_by(F.struct("version_sort_key", "repo_full_name"), "position")
    blocks = stored.groupBy(*PACKAGE, F.shiftright("position", _BITS).alias("block")).agg(F.count("*").alias("rows"), last.alias("last"))
    by_block = blocks.repartitionByRange(*PACKAGE, "block").sortWithinPartitions(*PACKAGE, "block")
    by_block.write.option("parquet.page.row.count.limit", str(BLOCK)).parquet(f"{path}/blocks")


def _after(key: Column, repo: Column, cursor: Cursor) -> Column:
    """Whether a row stands behind the cursor: a lower key, then a later repository, rows without a key last."""
    later = repo > F.lit(cursor.repo_full_name)
    if cursor.version_sort_key is None:
        return key.isNull() & later
    return key.isNull() | (key < F.lit(cursor.version_sort_key)) | ((key == F.lit(cursor.version_sort_key)) & later)


def page_after(
    spark: SparkSession, path: str, ecosystem: str, package_key: str, cursor: Cursor | None = None, limit: int | None = None
) -> DataFrame:
    """The ``limit`` rows of a package behind ``cursor``, the first ones without it, in order.

    The page's last row is the next cursor; a page shorter than ``limit`` is the last. A cursor
    need not be a row that is still there. A package that isn't there gives no rows.
    """
    limit = size_of(limit, DEFAULT_PAGE)
    own = (F.col("ecosystem") == F.lit(ecosystem)) & (F.col("package_key") == F.lit(package_key))
    behind = own if cursor is None else own & _after(F.col("version_sort_key"), F.col("repo_full_name"), cursor)
    blocks = spark.read.parquet(f"{path}/blocks").where(own)
    if cursor is not None:
        blocks = blocks.where(_after(F.col("last.version_sort_key"), F.col("last.repo_full_name"), cursor))
    # The first block may lie before the cursor but for a row; short ones stand where files end.
    ask = math.ceil(limit / BLOCK) + 2
    while True:
        found = blocks.orderBy("block").select("block", "rows").limit(ask).collect()
        if len(found) < ask or sum(row["rows"] for row in found[1:]) >= limit:
            break
        ask *= 2
    rows = spark.read.parquet(f"{path}/rows")
    if not found:
        return rows.where("false").drop("position")
    first, last = found[0]["block"] << _BITS, (found[-1]["block"] + 1) << _BITS
    reached = (F.col("position") >= F.lit(first)) & (F.col("position") < F.lit(last))
    return rows.where(reached & behind).orderBy("position").limit(limit).drop("position")


def cursor_of(page: DataFrame) -> Cursor | None:
    """The cursor behind a page, None for an empty one."""
    last = page.select("version_sort_key", "repo_full_name").tail(1)
    return Cursor(*last[0]) if last else None
