"""Tables that cut lineage, and small column helpers used by several operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomatlas.session import run_path

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase

#: A word is a run of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch while a table is written: whole texts are large rows.
BATCH_ROWS = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame under the shared folder and read it back: a lost executor costs no recomputation.

    Batches that go to Python are small meanwhile; the session's own setting is put back.
    """
    spark = frame.sparkSession
    path = run_path(spark, name)
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(min(int(before), BATCH_ROWS)) if int(before) > 0 else str(BATCH_ROWS))
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_ROWS, before)
    return spark.read.schema(frame.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else; the quick function serves texts that are all ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def whole_rows(frame: DataFrame, **keys: str) -> DataFrame:
    """Each row as the struct ``_row`` beside the columns ``keys`` names, so no column's name can clash."""
    return frame.select(*[F.col(f"`{column}`").alias(name) for name, column in keys.items()], F.struct("*").alias("_row"))


#: Bits of an id filter: 4 MB in 1,024 rows, whatever the number of ids.
FILTER_BITS = 25


def _spot(value: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{value}`")), F.lit(1 << FILTER_BITS))


def _bitmaps(ids: DataFrame) -> DataFrame:
    """``_bucket, _bits``: one bit for each id's hash."""
    at = ids.select(_spot(ids.columns[0]).alias("_at"))
    return at.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))


def _is_set() -> Column:
    bit = F.bitmap_bit_position("_spot")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (bit % 8).cast("int")) == 1


def flag_probable(frame: DataFrame, column: str, ids: DataFrame, flag: str) -> DataFrame:
    """``frame`` with a boolean ``flag``: ``column`` may be among the values of the only column of ``ids``.

    False is certain. The filter is a bitmap of fixed size, so sending it to every task is
    bounded; the more ids, the more other rows are flagged as well. Meant to stand before an
    exact join, so that the join need not move the texts of rows it would drop.
    """
    columns = [F.col(f"`{c}`") for c in frame.columns]
    rows = frame.withColumn("_spot", _spot(column)).withColumn("_bucket", F.bitmap_bucket_number("_spot"))
    return rows.join(F.broadcast(_bitmaps(ids)), "_bucket", "left").select(*columns, F.coalesce(_is_set(), F.lit(False)).alias(flag))


def probably_in(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows that :func:`flag_probable` flags: none that is among ``ids`` is lost.

    The flag comes from an outer join, so that no later semi join is moved below the filter.
    """
    return flag_probable(frame, column, ids, "_may").where("_may").drop("_may")


def thinned(frame: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """:func:`probably_in` as an inner join, for frames that meet no further filter by ``ids``."""
    columns = [F.col(f"`{c}`") for c in frame.columns]
    rows = frame.withColumn("_spot", _spot(column))
    same = (F.bitmap_bucket_number("_spot") == F.col("_bucket")) & _is_set()
    return rows.join(F.broadcast(_bitmaps(ids)), same).select(*columns)


def without_ids(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``documents`` but the rows whose ``doc_id`` is in ``ids`` (one column; null is an id like others).

    Rows that an id filter clears stay where they are; only the others are joined.
    """
    gone = ids.select(F.col(ids.columns[0]).alias("_gone")).distinct()
    flagged = flag_probable(whole_rows(documents, _id="doc_id"), "_id", gone, "_may")
    checked = flagged.where("_may").join(gone, F.col("_id").eqNullSafe(F.col("_gone")), "left_anti")
    return flagged.where("not _may").unionByName(checked).select("_row.*")
