"""Benchmark decontamination by spaced-seed hashing.

A seed is the hash of some of the words in a short window: a fixed mask says which, and the words
at its other positions are ignored, so a replaced word there doesn't matter. For each item length
there is a set of masks of which one hits wherever enough words agree, whichever others were
replaced; :func:`masks_for` proves it before it uses a set. Test and training hashes meet in an
equi join. A hit fixes how item and document line up; they are then compared around it, position
by position, along all near ways to line up that were hit: where words were inserted or left out,
one goes on as the other. A place counts when enough words of it agree.

Documents are read once. A bitmap of fixed size, filled from the test items' hashes, lets a
task drop seeds that no test item has; what passes is joined with the test hashes by an
equi join, so the bitmap only saves work and never decides. A fuller bitmap, from a larger
benchmark, passes more rows to that join. A second table of fixed size says how long the items
of a hash are at most, and with it how many words around a hit travel.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomatlas.llm.common import flag_probable, stored, whole_rows
from bomatlas.llm.tokens import CASELESS_VALUE, NO_LETTER, Powers, bytes_and_offsets, mix, slices, words_of

#: Sets of masks, the most selective first: 1 compares the word at its position, 0 ignores it. Each set
#: was searched for one range of item lengths at 80%, see :func:`masks_for`; the last fits any share.
MASKS = (
    ("101111", "111011"),
    ("101111", "111011", "111101"),
    ("111011", "1100111", "1101011"),
    ("10111", "11101"),
    ("1011", "1101"),
    ("1",),
)
#: Items of up to so many words whose words must all agree are one seed.
WHOLE = 7
#: Share of an item's words that must agree at their positions.
AGREE = 0.8
#: A part of an item is reported from so many agreeing words; a shorter item from its share of all words.
LEAST_OVERLAP = 16
#: Ways to line up that differ by so many inserted or missing words belong together.
NEAR_SHIFT = 10
#: So many ways to line up are compared at once, half of them again with the next: a bound for texts of one repeated word.
WINDOW = 64
#: Bits of the table of reaches: 2**20 bytes.
REACH_BITS = 20
#: The filter's size, 2**25 bits (4 MB), whatever the benchmark's size.
FILTER_BITS = 25

_SEEDS = "array<struct<mask:int,hash:bigint,pos:int>>"


def needed_words(n: int, agree: float, least: int = LEAST_OVERLAP) -> int:
    """How many words of an item of ``n`` must agree in one place."""
    return min(least, max(1, math.ceil(agree * n - 1e-9)))


def least_misses(masks: tuple[str, ...], length: int) -> list[int]:
    """For 0 to ``length`` words: the fewest replaced ones that leave no mask of the set a hit.

    Exact: a state is which of the last words agree, and each step keeps the fewest replaced
    words that lead to a state without a hit so far.
    """
    span = max(map(len, masks))
    codes = [int(m, 2) for m in masks]
    states = 1 << (span - 1)
    state, never = np.arange(states), length + 1
    fewest = np.where(state == 0, 0, never)  # words before the first don't agree
    least = [0]
    for _ in range(length):
        agreeing = state << 1 | 1
        hit = np.logical_or.reduce([agreeing & c == c for c in codes])
        after = np.full(states, never)
        np.minimum.at(after, (state << 1) & (states - 1), fewest + 1)
        np.minimum.at(after, agreeing & (states - 1), np.where(hit, never, fewest))
        fewest = np.minimum(after, never)
        least.append(int(fewest.min()))
    return least


def masks_for(n: int, agree: float, least: int = LEAST_OVERLAP) -> tuple[str, ...]:
    """Masks of which one hits in every place that counts, for an item of ``n`` words.

    A place of ``size`` words has so many replaced ones at most; the set must need more than that
    to be without a hit. Two places side by side need at least the sum of what each needs, so what
    holds for all sizes from ``free`` to twice that holds for all longer ones too.
    """
    needed = needed_words(n, agree, least)
    if needed >= n and n <= WHOLE:
        return ("1" * max(n, 1),)
    free = math.ceil(needed / agree) + 1  # from here on only the share limits the replaced words

    longest = min(n, 2 * free)

    def proved(masks: tuple[str, ...]) -> bool:
        fewest = least_misses(masks, longest)
        return all(fewest[size] > min(size - needed, math.floor(size * (1 - agree) + 1e-9)) for size in range(needed, longest + 1))

    return next(masks for masks in MASKS if proved(masks))


def _hashed(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the words under the mask, by the position of its first word."""
    total = len(hashes) - len(mask) + 1
    if total <= 0:
        return np.empty(0, np.uint64)
    out = np.full(total, int(mask, 2), np.uint64)
    for j, compared in enumerate(mask):
        if compared == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + total]
    return mix(out)


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << FILTER_BITS) - 1)
    return hashes & low, (hashes >> np.uint64(64 - FILTER_BITS))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(8)) & np.uint64((1 << REACH_BITS) - 1)


def _item_rows(agree: float, least: int):
    seed = pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, sets = Powers(), {}
        for batch in batches:
            data, at = bytes_and_offsets(batch.column("text"))
            for low, high in slices(at):
                words = words_of(data, at[low : high + 1], powers, NO_LETTER, CASELESS_VALUE)
                seeds, counts = [], []
                for a, b in zip(words.first[:-1], words.first[1:]):
                    item = words.hashes[a:b]
                    if len(item) not in sets:
                        sets[len(item)] = masks_for(len(item), agree, least)
                    seeds.append(
                        [
                            {"mask": int(mask, 2), "hash": int(h), "pos": i}
                            for mask in sets[len(item)]
                            for i, h in enumerate(_hashed(item, mask).view(np.int64))
                        ]
                    )
                    counts.append(item.view(np.int64))
                yield pa.record_batch(
                    [batch.column("item_id").slice(low, high - low), pa.array(counts, pa.list_(pa.int64())), pa.array(seeds, pa.list_(seed))],
                    names=["item_id", "item", "seeds"],
                )

    return rows


def _filter_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, reach = np.zeros(1 << FILTER_BITS, bool), np.zeros(1 << REACH_BITS, np.uint8)
    for batch in batches:
        hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in _bits(hashes):
            table[at] = True
        sizes = np.ceil(np.log2(batch.column("size").to_numpy())).astype(np.uint8)
        np.maximum.at(reach, _slots(hashes), sizes)
    yield pa.record_batch([pa.array([np.packbits(table).tobytes()], pa.binary()), pa.array([reach.tobytes()], pa.binary())], names=["bits", "reach"])


def _hit_rows(sent, masks: list[str]):
    """For ``mapInArrow``: seeds of each document that pass the filter, with the words around them.

    Around a seed lie as many words on either side as the longest item of its hash has, so every
    way to line up an item with it lies inside. Stretches that overlap share one row.
    """
    seed = pa.struct([("mask", pa.int32()), ("hash", pa.int64()), ("pos", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        bits, reaches = (np.frombuffer(part, np.uint8) for part in sent.value)
        table = np.unpackbits(bits).view(bool)
        for batch in batches:
            data, at = bytes_and_offsets(batch.column("text"))
            ids = batch.column("doc_id")
            for low, high in slices(at):
                words = words_of(data, at[low : high + 1], powers, NO_LETTER, CASELESS_VALUE)
                text = words.text_of()
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for mask in masks:
                    hashes = _hashed(words.hashes, mask)
                    one, two = _bits(hashes)
                    hit = np.flatnonzero(table[one])
                    hit = hit[table[two[hit]]]
                    hit = hit[text[hit] == text[hit + len(mask) - 1]]
                    found.append((hit, np.full(len(hit), int(mask, 2)), hashes[hit]))
                place, mask_of, hashes = (np.concatenate(x) for x in zip(*found))
                reach = np.left_shift(1, reaches[_slots(hashes)].astype(np.int64))
                begin = np.maximum(place - reach, words.first[text[place]])
                end = np.minimum(place + reach, words.first[text[place] + 1])
                order = np.argsort(begin, kind="stable")
                place, mask_of, hashes, begin, end = place[order], mask_of[order], hashes[order].view(np.int64), begin[order], end[order]
                furthest = np.maximum.accumulate(end)
                new = np.ones(len(place), bool)
                new[1:] = begin[1:] >= furthest[:-1]
                starts = np.flatnonzero(new)
                docs, digests, starts_at, around, seeds = [], [], [], [], []
                for a, b in zip(starts, np.append(starts[1:], len(place))):
                    t = text[place[a]]
                    first = words.first[t]
                    docs.append(low + t)
                    digests.append(hashlib.sha256(data[at[low + t] : at[low + t + 1]].tobytes()).hexdigest())
                    starts_at.append(begin[a] - first)
                    around.append(words.hashes[begin[a] : furthest[b - 1]].view(np.int64))
                    seeds.append([{"mask": m, "hash": h, "pos": p} for m, h, p in zip(mask_of[a:b].tolist(), hashes[a:b].tolist(), (place[a:b] - first).tolist())])
                if docs:
                    yield pa.record_batch(
                        [
                            ids.take(pa.array(docs)),
                            pa.array(digests, pa.string()),
                            pa.array(starts_at, pa.int32()),
                            pa.array(around, pa.list_(pa.int64())),
                            pa.array(seeds, pa.list_(seed)),
                        ],
                        names=["doc_id", "sha", "begin", "words", "seeds"],
                    )

    return rows


def _place(same: np.ndarray, agree: float) -> tuple[int, int, int]:
    """The place ``[a, b)`` where at least ``agree`` of the flags are set that has most of them: how many, a, b."""
    level = np.concatenate([[0.0], np.cumsum(same - agree)])
    # The furthest end for each start: the highest level from there on is not below the start's.
    later = np.maximum.accumulate(level[::-1])
    end = len(same) - np.searchsorted(later, level - 1e-9)
    total = np.concatenate([[0], np.cumsum(same)])
    start = int(np.argmax(total[end] - total))
    return int(total[end[start]] - total[start]), start, int(end[start])


def _joined(same: np.ndarray, shifts: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """The best way through ``same`` (shift, item word), changing shifts, and each step's word of the document.

    Words the document has inserted are steps without agreement; item words it left out are
    steps anyhow, as the next shift doesn't have them at their positions.
    """
    more = shifts[:, None] - shifts[None, :]  # of the row's shift over the column's
    cost = np.where(more > 0, more.astype(float), -more * 1e-3)
    cost[np.abs(more) > near] = np.inf
    value, back = same[:, 0].astype(float), []
    for i in range(1, same.shape[1]):
        ways = value[None, :] - cost
        before = ways.argmax(axis=1)
        back.append(before)
        value = ways[np.arange(len(shifts)), before] + same[:, i]
    path = [int(value.argmax())]
    for before in reversed(back):
        path.append(int(before[path[-1]]))
    path = np.array(path[::-1])
    flags, word = same[path, np.arange(len(path))], shifts[path] + np.arange(len(path))
    inserted = np.repeat(np.arange(1, len(path)), np.maximum(np.diff(shifts[path]), 0))
    return np.insert(flags, inserted, False), np.insert(word, inserted, -1)


def _compare(agree: float, least: int, near_shift: int | None, window: int | None):
    """For ``mapInArrow``: the best place of one item in each row's words, if one counts."""

    def best(item: np.ndarray, words: np.ndarray, begin: int, shifts: np.ndarray) -> tuple[int, int] | None:
        places = []
        shifts = np.sort(shifts)
        near, most = math.inf if near_shift is None else near_shift, window or len(shifts) + 1
        groups = np.split(shifts, np.flatnonzero(np.diff(shifts) > near) + 1)
        step = max(most // 2, 1)
        for group in (g[i : i + most] for g in groups for i in range(0, max(len(g) - step, 1), step)):
            at = group[:, None] - begin + np.arange(len(item))
            inside = (at >= 0) & (at < len(words))
            same = inside & (words[np.where(inside, at, 0)] == item)
            ways = [(flags, shift + np.arange(len(item))) for flags, shift in zip(same, group)]
            ways += [_joined(same, group, near)] if len(group) > 1 else []
            for flags, word in ways:
                matched, a, b = _place(flags, agree)
                if matched >= needed_words(len(item), agree, least):
                    places.append((matched, -int(word[a + flags[a:b].argmax()])))
        return max(places, default=None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = batch.column("begin").to_numpy()
            found = []
            for i, columns in enumerate(zip(batch.column("item"), batch.column("words"), batch.column("shifts"))):
                item, words, shifts = (c.values.to_numpy(zero_copy_only=False) for c in columns)
                place = best(item, words, int(begin[i]), shifts)
                if place:
                    found.append((i, place[0], len(item), -place[1]))
            at, matched, size, start = (list(x) for x in zip(*found)) if found else ([], [], [], [])
            yield pa.record_batch(
                [*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("doc_id", "sha", "item_id")), *(pa.array(x, pa.int32()) for x in (matched, size, start))],
                names=["doc_id", "sha", "item_id", "matched", "item_words", "start_word"],
            )

    return rows


def _found(
    documents: DataFrame,
    benchmark: DataFrame,
    agree: float = AGREE,
    least_overlap: int = LEAST_OVERLAP,
    near_shift: int | None = NEAR_SHIFT,
    window: int | None = WINDOW,
) -> DataFrame:
    """The best place of each test item in each document, a document being an id and the SHA-256 of its text."""
    spark = documents.sparkSession
    items = stored(
        benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct().mapInArrow(
            _item_rows(agree, least_overlap), f"item_id {dict(benchmark.dtypes)['item_id']}, item array<bigint>, seeds {_SEEDS}"
        ),
        "items",
    )
    seeds = items.select("item_id", F.size("item").alias("size"), F.explode("seeds").alias("seed")).select("item_id", "size", "seed.*")
    parts = seeds.select("hash", "size").coalesce(8).mapInArrow(_filter_part, "bits binary, reach binary").collect()
    bits, reach = np.zeros(1 << (FILTER_BITS - 3), np.uint8), np.zeros(1 << REACH_BITS, np.uint8)
    for part in parts:
        bits |= np.frombuffer(part.bits, np.uint8)
        reach = np.maximum(reach, np.frombuffer(part.reach, np.uint8))
    masks = sorted(f"{row.mask:b}" for row in seeds.select("mask").distinct().collect())  # as many as MASKS has, and whole items
    near = stored(
        documents.select("doc_id", "text").mapInArrow(
            _hit_rows(spark.sparkContext.broadcast((bits.tobytes(), reach.tobytes())), masks or ["1"]),
            f"doc_id {dict(documents.dtypes)['doc_id']}, sha string, begin int, words array<bigint>, seeds {_SEEDS}",
        ).withColumn("row", F.expr("uuid()")),
        "hits",
    )
    hits = near.select("row", F.explode("seeds").alias("seed")).select("row", "seed.mask", "seed.hash", F.col("seed.pos").alias("at"))
    lined_up = hits.join(seeds, ["mask", "hash"]).groupBy("row", "item_id").agg(F.collect_set(F.col("at") - F.col("pos")).alias("shifts"))
    # Word i of the item stands at word shift + i of the document; only the words that any shift reaches travel.
    low = F.greatest(F.array_min("shifts"), F.col("begin"))
    reached = F.slice("words", low - F.col("begin") + 1, F.greatest(F.array_max("shifts") - low, F.lit(0)) + F.size("item"))
    types = {"doc_id": dict(documents.dtypes)["doc_id"], "item_id": dict(benchmark.dtypes)["item_id"]}
    pairs = (
        lined_up.join(near.select("row", "doc_id", "sha", "begin", "words"), "row")
        .join(items.select("item_id", "item").withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item")))
        .select("doc_id", "sha", "item_id", "item", "shifts", low.alias("begin"), reached.alias("words"))
    )
    compared = pairs.mapInArrow(
        _compare(agree, least_overlap, near_shift, window), f"doc_id {types['doc_id']}, sha string, item_id {types['item_id']}, matched int, item_words int, start_word int"
    )
    return _best(stored(compared, "places"), "doc_id", "sha", "item_id")


def _best(places: DataFrame, *keys: str) -> DataFrame:
    best = F.max(F.struct("matched", "item_words", (-F.col("start_word")).alias("back"))).alias("best")
    return places.groupBy(*keys).agg(best).select(*keys, "best.matched", "best.item_words", (-F.col("best.back")).alias("start_word"))


def leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    agree: float = AGREE,
    least_overlap: int = LEAST_OVERLAP,
    near_shift: int | None = NEAR_SHIFT,
    window: int | None = WINDOW,
) -> DataFrame:
    """``doc_id, item_id, matched, item_words, share, start_word``: the test items found in documents.

    One row for each (document, item), with its best place: where at least ``agree`` of the words
    agree and these are ``agree`` of the item's, or ``least_overlap`` words of a longer one.
    ``share`` is that of the item, so that of a part is lower. Replaced words are found wherever they
    stand. Words inserted or left out, up to ``near_shift`` at once (None: any number), count like
    replaced ones if seeds on both sides are hit; ``window`` ways to line up are compared at a time
    (None: all, which needs memory for each pair of them).

    Words are runs of letters and digits, compared without case. An item without words can't be
    found; one of few words is found wherever they stand in a row. Very long texts are compared only
    around hits. Of places with equally many agreeing words the first is reported. Repeated rows of
    an item count once; rows of one id and text, or of one id and other texts, share their rows here,
    and :func:`clean` tells the latter apart. Null texts are empty; null ids are ids like others.
    Empty tables give an empty result. Other columns aren't read.
    """
    return _best(_found(documents, benchmark, agree, least_overlap, near_shift, window), "doc_id", "item_id").select(
        "doc_id",
        "item_id",
        F.col("matched").cast("long").alias("matched"),
        F.col("item_words").cast("long").alias("item_words"),
        (F.col("matched") / F.col("item_words")).alias("share"),
        F.col("start_word").cast("long").alias("start_word"),
    )


def clean(documents: DataFrame, benchmark: DataFrame, agree: float = AGREE) -> DataFrame:
    """``documents`` without the rows whose text holds a test item; other texts of the same id, null too, stay."""
    leaking = stored(_found(documents, benchmark, agree).select(F.col("doc_id").alias("_gone"), F.col("sha").alias("_digest")).distinct(), "leaks")
    flagged = flag_probable(whole_rows(documents, _id="doc_id"), "_id", leaking.select("_gone"), "_may")
    digest = F.sha2(F.coalesce(F.col("_row")["text"], F.lit("")), 256)
    same = F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_sha") == F.col("_digest"))
    checked = flagged.where("_may").withColumn("_sha", digest).join(leaking, same, "left_anti").drop("_sha")
    return flagged.where("not _may").unionByName(checked).select("_row.*")
