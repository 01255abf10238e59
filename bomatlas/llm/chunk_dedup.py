"""Exact dedup by content-defined chunk recipes.

A text is cut where its own content says so, at the first line or sentence end after
``SHORTEST`` characters. Its recipe is the ordered list of its chunks' fingerprints. Texts
whose recipe nobody shares are settled by that small list alone. Only the others send their
chunks once, grouped by fingerprint: if the smallest and the largest content of a fingerprint
are the same bytes, the fingerprint is a verified identifier. Ordered identifier lists are
then compared, so no document travels as a whole, and copies are reduced in each task first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bomatlas.llm.common import ascii_lower, flag_probable, probably_in, stored, whole_rows

SHORTEST, LONGEST = 1024, 8192
#: A chunk ends at a line or sentence end past the shortest length, or at the longest.
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST}}}?(?:\n|[.!?]\s|\z)|.{{1,{LONGEST}}}"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def _fingerprint(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def exact_copies(documents: DataFrame) -> DataFrame:
    """One row for each row of ``documents``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. The largest
    ``doc_id`` of a group stays. Rows that repeat both ``doc_id`` and text count as rows, and
    the ones with the kept id are all marked kept. A null id is below all others. Other columns
    are not read. An empty table gives an empty result.
    """
    text = normalised(F.col("text"))
    recipes = stored(
        documents.select("doc_id", text.alias("_text")).select(
            "doc_id",
            F.sha2("_text", 256).alias("text_sha256"),
            F.char_length("_text").alias("_length"),
            F.transform(F.regexp_extract_all("_text", F.lit(CHUNK), F.lit(0)), _fingerprint).alias("_recipe"),
        ).withColumn("_key", F.xxhash64("_length", "_recipe")),
        "recipes",
    )
    shared = recipes.groupBy("_key").agg(F.count("*").alias("_rows")).where("_rows > 1").select("_key")
    suspects = stored(recipes.join(shared, "_key", "left_semi").select("doc_id", "_length", "_recipe", "_key"), "suspects")
    chunks = (
        probably_in(documents.select("doc_id", "text"), "doc_id", suspects.select("doc_id"))
        .join(suspects.select("doc_id").distinct(), "doc_id", "left_semi")
        .select(F.explode(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))).alias("_chunk"))
        .select(_fingerprint(F.col("_chunk")).alias("_print"), "_chunk")
    )
    clashes = chunks.groupBy("_print").agg(F.min("_chunk").alias("_low"), F.max("_chunk").alias("_high")).where("_low <> _high").select("_print")
    # Documents with a chunk whose fingerprint has several contents (practically none) get
    # the digest of the whole text into their identifier list.
    unsure = (
        suspects.select("_key", F.explode("_recipe").alias("_print"))
        .distinct()
        .join(clashes, "_print", "left_semi")
        .select("_key", F.lit(True).alias("_unsure"))
        .distinct()
    )
    listed = recipes.join(unsure, "_key", "left").select(
        "doc_id",
        "text_sha256",
        F.xxhash64("_key", F.when(F.col("_unsure"), F.col("text_sha256"))).alias("_group"),
        "_length",
        "_recipe",
        F.when(F.col("_unsure"), F.col("text_sha256")).alias("_digest"),
    )
    same = ["_group", "_length", "_recipe"]
    digest = F.coalesce("_digest", F.lit("")).alias("_digest")
    listed = stored(listed.select("doc_id", "text_sha256", *same, digest), "identifiers")
    groups = (
        listed.groupBy(*same, "_digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    return listed.join(groups, [*same, "_digest"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id").eqNullSafe(F.col("keep_id")) | F.col("group_size").isNull(), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group of equal texts, the one of largest ``doc_id``.

    Of rows that also share the id, any one stays (they may differ in other columns or in case).
    """
    copies = stored(exact_copies(documents), "copies").select("doc_id", F.col("text_sha256").alias("_sha"), "kept")
    again = copies.where("kept").groupBy("doc_id", "_sha").agg(F.count("*").alias("rows")).where("rows > 1")
    dropped = copies.where("not kept").select(F.col("doc_id").alias("_id"), F.col("_sha").alias("_digest")).distinct()
    wanted = dropped.select("_id").unionByName(again.select(F.col("doc_id").alias("_id")))
    flagged = flag_probable(whole_rows(documents, _key="doc_id"), "_key", wanted, "_may")
    digest = F.sha2(normalised(F.col("_row")["text"]), 256)
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest"))
    checked = flagged.where("_may").withColumn("_sha", digest).join(dropped, same, "left_anti").dropDuplicates(["_key", "_sha"])
    return flagged.where("not _may").unionByName(checked.drop("_sha")).select("_row.*")
