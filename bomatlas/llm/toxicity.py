"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A feature is present or not: single words, pairs of neighbours, and pairs with one word
between them, hashed to 2**22 slots. FTRL-proximal keeps a learning rate for each slot and
sets slots without steady evidence to exactly zero, so the weights are a short list of slots,
at most as many as the table has, and travel to every task.

Training takes the first ``rows`` labelled rows in the order of a hash of their id, a
documented bound that also bounds the one task which learns; scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomatlas.llm.common import stored
from bomatlas.llm.tokens import Powers, Words, bytes_and_offsets, mix, slices, words_of

SLOT_BITS = 22
#: Labelled rows learned from, at most.
TRAINING_ROWS = 16_000
#: Step size, smoothing, L1 and L2 of FTRL-proximal, and passes over the training rows.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 4.0, 0.0, 8
THRESHOLD = 0.7


def _slots(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The slots of every word, pair and skip-gram, and the text of each; slots may repeat."""
    hashes, text = words.hashes, words.text_of()
    parts, owners = [hashes], [text]
    for gap, seed in ((1, 0xA5A5), (2, 0x5A5A5A)):
        if len(hashes) > gap:
            same = text[gap:] == text[:-gap]
            pair = hashes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:] + np.uint64(seed)
            parts.append(mix(pair)[same])
            owners.append(text[gap:][same])
    return (np.concatenate(parts) >> np.uint64(64 - SLOT_BITS)).astype(np.int64), np.concatenate(owners)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        data, at = bytes_and_offsets(batch.column("text"))
        rows: list[np.ndarray] = []
        for low, high in slices(at):
            slots, owner = _slots(words_of(data, at[low : high + 1], powers))
            pairs = np.unique((owner << SLOT_BITS) | slots)
            ends = np.searchsorted(pairs, np.arange(high - low + 1) << SLOT_BITS)
            slots = (pairs & ((1 << SLOT_BITS) - 1)).astype(np.int32)
            rows += [slots[a:b] for a, b in zip(ends[:-1], ends[1:])]
        yield pa.record_batch(
            [batch.column("doc_id"), batch.column("toxic"), pa.array([r.tobytes() for r in rows], pa.binary())],
            names=["doc_id", "toxic", "slots"],
        )


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL-proximal over all rows of this task, in the order of a hash of their ids."""
    rows = []
    for batch in batches:
        ids, toxic, slots = (batch.column(n).to_pylist() for n in ("doc_id", "toxic", "slots"))
        rows += list(zip(ids, toxic, (np.frombuffer(s, np.int32) for s in slots)))
    if not rows:
        return
    rows.sort(key=lambda r: (int(mix(np.array([r[0]], np.int64).view(np.uint64))[0]), r[0], r[1], len(r[2])))
    bias = 1 << SLOT_BITS
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        limit = np.where(at == bias, 0.0, L1)
        return np.where(np.abs(zs) <= limit, 0.0, (np.sign(zs) * limit - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for _, label, slots in rows:
            at = np.append(slots, bias)
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[at] + slope * slope)
            z[at] += slope - (root - np.sqrt(n[at])) / ALPHA * w
            n[at] += slope * slope
    for low in range(0, bias + 1, 1 << 18):
        part = np.arange(low, min(low + (1 << 18), bias + 1))
        w = weights(part)
        kept = np.flatnonzero(w)
        yield pa.record_batch([pa.array(part[kept].astype(np.int32)), pa.array(w[kept].astype(np.float64))], names=["slot", "weight"])


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and their weights; the slot past the last is the bias.

    ``labels``: ``doc_id, toxic``. Rows with a null in either are left out, of several rows
    for one document the largest label counts. Without labels every weight is zero.
    """
    taken = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most ``rows`` pairs of numbers, so sending them beats moving every text.
    texts = documents.select("doc_id", "text").join(F.broadcast(taken), "doc_id")
    features = texts.mapInArrow(_features, "doc_id long, toxic int, slots binary")
    # The slots of a bounded number of rows meet in one task; they are found in many.
    # Written first, as whole texts then travel to Python in small batches.
    learned = stored(features.repartition(1).mapInArrow(_learn, "slot int, weight double"), "weights").toArrow()
    return learned.column("slot").to_numpy(), learned.column("weight").to_numpy()


def score(documents: DataFrame, slots: np.ndarray, weights: np.ndarray) -> DataFrame:
    """All columns of ``documents`` and ``score``, the probability of being toxic.

    Null and empty texts have the score of the bias alone. An existing column ``score`` is replaced.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((slots, weights.astype(np.float64)))
    keep = [c for c in documents.columns if c != "score"]
    frame = documents.select(*[F.col(f"`{c}`") for c in keep])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, table = Powers(), np.zeros((1 << SLOT_BITS) + 1)
        table[sent.value[0]] = sent.value[1]
        for batch in batches:
            data, at = bytes_and_offsets(batch.column(batch.schema.get_field_index("text")))
            total = np.full(batch.num_rows, table[-1])
            for low, high in slices(at):
                found, owner = _slots(words_of(data, at[low : high + 1], powers))
                hit = table[found] != 0
                pairs = np.unique((owner[hit] << SLOT_BITS) | found[hit])
                total[low:high] += np.bincount(pairs >> SLOT_BITS, table[pairs & ((1 << SLOT_BITS) - 1)], minlength=high - low)
            values = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.record_batch([*batch.columns, pa.array(values)], names=[*keep, "score"])

    return frame.mapInArrow(scored, T.StructType([*frame.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """True for rows that must not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def judged(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents``."""
    slots, weights = train(documents, labels.where(~held_out()), rows)
    return score(documents.select("doc_id", "text"), slots, weights).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
