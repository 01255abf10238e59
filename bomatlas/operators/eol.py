"""End-of-life status of framework versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomatlas.sources.refdata import eol_product


def is_eol(eol: Column, as_of: Column) -> Column:
    """true is true; false and NULL are false; a date has passed once its midnight has.

    Text that is no date gives NULL, for unknown.
    """
    text = F.lower(eol)
    return (
        F.when(text == "true", F.lit(True))
        .when(eol.isNull() | (text == "false"), F.lit(False))
        .otherwise(F.try_to_timestamp(eol, F.lit("yyyy-MM-dd")) < as_of)
    )


def dotted_prefixes(version: Column) -> Column:
    """``1.11.5`` gives ``1``, ``1.11`` and ``1.11.5``."""
    parts = F.split(version, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ".")
    )


def eol_status(rows: DataFrame, cycles: DataFrame, as_of: Column) -> DataFrame:
    """Add product, cycle, eol and is_eol for rows of known frameworks; others are dropped.

    A cycle matches when it is a dotted prefix of the version; the longest wins. The
    prefixes of the few distinct versions are exploded, which makes it an equi join.
    """
    mapped = rows.withColumn("product", eol_product(F.col("ecosystem"), F.col("package_key"))).where(
        F.col("product").isNotNull() & (F.col("version_raw") != "")
    )
    versions = mapped.select("product", "version_raw").distinct()
    prefixes = versions.select(
        "product", "version_raw", F.explode(dotted_prefixes(F.col("version_raw"))).alias("cycle")
    )
    best = (
        prefixes.join(cycles.select("product", "cycle", "eol"), ["product", "cycle"])
        .groupBy("product", "version_raw")
        .agg(F.max(F.struct(F.length("cycle").alias("size"), "cycle", "eol")).alias("m"))
        .select("product", "version_raw", "m.cycle", "m.eol")
    )
    return mapped.join(best, ["product", "version_raw"], "left").withColumn(
        "is_eol", F.when(F.col("cycle").isNotNull(), is_eol(F.col("eol"), as_of))
    )
