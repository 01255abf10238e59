"""Importance resampling: draw the documents that look most like a target text collection.

A text's bytes go through a 256-byte table that lower-cases A-Z and blanks separators,
``bytes.split`` yields the words, and the checksum of a run of words extends the checksum of
the run without its last word. Runs fall into a fixed number of buckets. A bucket's gain is
the logarithm of how much oftener the target has it than the documents, a document's weight
the mean gain of its runs, and Gumbel noise from a hash of the id turns the best scores into
a sample without replacement.

Only counts per bucket and per score meet: two arrays of fixed size. The ranks of the drawn
rows come from ranges of the order (score, id) and the number of rows before each range.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomatlas.llm.common import LOWER, UPPER, probably_in, stored

#: Words in the longest run, buckets, and words a document needs to be drawn.
WORDS, BUCKETS, LEAST_WORDS = 1, 10_000, 20
#: Share of the eligible documents that is drawn, and the seed of their noise.
PERCENT, SEED = 10, 2024

#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Scores of a first histogram's bin; the bin of the cut is then counted score by score.
BIN = 256

_LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
_WORD = frozenset(b"0123456789" + LOWER.encode() + bytes(range(0x80, 0x100)))
TABLE = bytes(b if b in _WORD else 0x20 for b in _LOWERED)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about a megabyte at a time; a piece ends where a word does."""
    low, size = 0, len(text)
    while low < size:
        high = size
        if size - low > PIECE:
            high = text.rfind(b" ", low, low + PIECE)
            high = high if high > low else text.find(b" ", low + PIECE)
            high = high if high > low else size
        yield text[low:high].split()
        low = high


def run_sums(text: bytes, most: int) -> Iterator[tuple[int, list[int]]]:
    """``(words, checksums of all runs of 1 to most words)`` for each piece of a text."""
    before: list[bytes] = []
    for words in _pieces(text.translate(TABLE)):
        sums = found = list(map(crc32, words))
        if most > 1:
            line = before + words
            sums, found = list(map(crc32, line)), list(found)
            for n in range(2, most + 1):
                # The run that begins at i and had n - 1 words takes the word at i + n - 1.
                sums = [crc32(b" " + word, sum_) for sum_, word in zip(sums, line[n - 1 :])]
                # Runs that end in the words carried over were counted with the piece before.
                found += sums[max(0, len(before) - n + 1) :]
            before = line[1 - most :]
        yield len(words), found


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.large_binary()):
        yield text.as_py() or b""


def bucket_counts(texts: DataFrame, most: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """Runs of all rows' ``text`` per bucket. One row per bucket and task meets in Spark, ``buckets`` rows here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)

        def reduce(seen: Counter) -> None:
            at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
            np.add.at(total, at, np.fromiter(seen.values(), np.int64, len(seen)))
            seen.clear()

        seen: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                for _, found in run_sums(text, most):
                    seen.update(found)
                    if len(seen) > PIECE:
                        reduce(seen)
        reduce(seen)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "runs"])

    parts = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, runs long")
    whole = parts.groupBy("bucket").agg(F.sum("runs").alias("runs")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[whole.column("bucket").to_numpy()] = whole.column("runs").to_numpy()
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of each bucket's smoothed shares."""
    buckets, own_all, target_all = len(own), int(own.sum()), int(target.sum())
    ratio = ((target + 1.0) * (own_all + buckets)) / ((own + 1.0) * (target_all + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def scored(
    documents: DataFrame, target: DataFrame, most: int = WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` for every row of ``documents``."""
    gain = gains(bucket_counts(documents, most, buckets), bucket_counts(target, most, buckets))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(batch):
                n_words = n_runs = total = 0
                for words, found in run_sums(text, most):
                    seen = Counter(found)
                    at = np.fromiter(seen.keys(), np.int64, len(seen)) % buckets
                    total += int(gain[at] @ np.fromiter(seen.values(), np.int64, len(seen)))
                    n_words, n_runs = n_words + words, n_runs + len(found)
                rows.append((n_words, n_runs, total // n_runs if n_runs else 0))
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.record_batch([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    doc_id = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        weigh, f"doc_id {doc_id}, n_words long, n_features long, weight long"
    )
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hashed = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((hashed + 0.5) / 4294967296.0)))
    return rows.select("*", (F.col("weight") + noise).cast("long").alias("score"))


def _cut(eligible: DataFrame, percent: int) -> tuple[int, int]:
    """How many rows are drawn, and a score that all of them reach and few others do."""

    def down(counts: list, rank: int) -> tuple[int, int]:
        for row in sorted(counts, key=lambda r: -r[0]):
            if rank <= row[1]:
                return row[0], rank
            rank -= row[1]
        raise ValueError("fewer rows than ranks")

    bins = eligible.groupBy(F.floor(F.col("score") / BIN).alias("bin")).count().collect()
    drawn = percent * sum(n for _, n in bins) // 100
    if not drawn:
        return 0, 0
    in_bin, rank = down(bins, drawn)
    scores = eligible.where(F.floor(F.col("score") / BIN) == in_bin).groupBy("score").count().collect()
    return drawn, down(scores, rank)[0]


def resampled(
    documents: DataFrame,
    target: DataFrame,
    most: int = WORDS,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``documents``.

    ``rank`` counts the drawn rows from 1, best score first, equal scores by smaller
    ``doc_id`` (null ids last); rows equal in both follow one another in the order they were
    stored, and differ in nothing but ``n_features`` then. Other rows have a null rank. Null
    and empty texts have no runs and weight 0, and are never drawn unless ``least_words`` is 0.
    Texts of any length are read a megabyte at a time. Without target texts all gains compare
    with an even spread; without documents the result is empty. Of extra columns, whatever
    their names, only ``doc_id`` and ``text`` are read.
    """
    rows = stored(scored(documents, target, most, buckets, seed).withColumn("_row", F.monotonically_increasing_id()), "scores")
    eligible = F.col("n_words") >= least_words
    drawn, cut = _cut(rows.where(eligible), percent)
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    if not drawn:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    near = eligible & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that a row's range is settled before anything counts on it.
    ranged = stored(rows.where(near).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.join(starts, "_range").select("*", place.alias("_place"))
    rank = F.when(F.col("_place") <= drawn, F.col("_place")).cast("long")
    return ranked.select(*out, rank.alias("rank")).unionByName(rows.where(~near).select(*out, F.lit(None).cast("long").alias("rank")))


def sample(documents: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of ``documents`` with all their columns. Of rows with one id, all are drawn or none."""
    drawn = stored(resampled(documents, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct(), "drawn")
    return probably_in(documents, "doc_id", drawn).join(drawn, F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")
