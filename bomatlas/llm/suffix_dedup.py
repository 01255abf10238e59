"""Removal of repeated byte strings by longest previous factors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier, in a document
of smaller id or earlier in the same one. In suffix order, strings that share ``LENGTH`` bytes
stand next to each other; the longest previous factor of a position reaches ``LENGTH``
exactly if its previous or next smaller position in that order lies within the same block of
neighbours, that is, unless it is the block's smallest position. So the array is only needed
for positions that could have a twin, and only ``LENGTH`` bytes deep.

Which positions could is found without sorting text. In each string of ``LENGTH`` bytes the
piece of ``PIECE`` bytes with the smallest hash is its anchor; equal strings have equal
anchors at equal offsets. Neighbouring strings share an anchor, so a text falls into runs of
some 40 strings with one anchor each:

1. A task finds the runs of its documents and drops those it has seen, content and all; the
   rest, a few numbers each, is dealt by the anchor's hash in packed arrays.
2. Runs with an anchor of their own have no twin. Of runs equal in content the earliest stays,
   the others go as a whole. Anchors with several different contents are open.
3. The first run of each open content sends its bytes to the anchor's task, where its strings
   are put in suffix order and the blocks are settled. Where an anchor has very many contents,
   its strings are dealt by their own 128-bit hash instead, so no group is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomatlas.llm.common import flag_probable, stored
from bomatlas.llm.tokens import Powers, bytes_and_offsets, gathered, mix, slices

LENGTH, PIECE = 100, 24
#: Contents of one anchor from which its strings are dealt one by one.
HOT_CONTENTS = 2_000
#: Bytes of one text worked on at once; the strings of the next part follow without a gap.
PART = 1 << 19
#: Strings put in suffix order at once.
SORTED_AT_ONCE = 50_000

_WIDTH = LENGTH - PIECE + 1  # pieces in a string
_PLACE_BITS = np.uint64(24)
_NO_ID = -(1 << 63)
#: Values of each byte for two independent hashes.
_VALUES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(f)) for f in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)]

_RUN = [("anchor", np.uint64), ("content", np.uint64), ("id", np.int64), ("text", np.int64), ("start", np.int32), ("more", np.uint8), ("back", np.uint8)]
_SPANS = "id long, text long, start int, stop int"


def _sums(data: np.ndarray, values: np.ndarray, up: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return sums


def _runs(data: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: text, first string, strings after it, anchor's offset, both hashes."""
    total = len(data) - LENGTH + 1
    if total <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up, down = powers.upto(len(data))
    sums = _sums(data, _VALUES[0], up)
    pieces = mix((sums[PIECE:] - sums[:-PIECE]) * down[: len(data) - PIECE + 1])
    low = np.uint64((1 << int(_PLACE_BITS)) - 1)
    keys = (pieces & ~low) | np.arange(len(pieces), dtype=np.uint64)
    # Smallest key of every _WIDTH neighbours: running minima from both ends of blocks that long.
    rows = -(-len(keys) // _WIDTH)
    padded = np.full(rows * _WIDTH, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    block = padded.reshape(rows, _WIDTH)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(behind[:total], ahead[_WIDTH - 1 : _WIDTH - 1 + total]) & low).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    long = np.flatnonzero(np.diff(at) >= LENGTH)
    inside[at[long]] += 1
    inside[at[long + 1] - LENGTH + 1] -= 1
    strings = np.flatnonzero(np.cumsum(inside)[:total])
    if not len(strings):
        return _runs(data[:0], at[:1], powers)
    anchor = anchor[strings]
    new = np.ones(len(strings), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(strings)) - 1
    begin, end, anchor = strings[first], strings[last], anchor[first]
    shape = ((end - begin).astype(np.uint64) << np.uint64(8)) | (anchor - begin).astype(np.uint64)
    content = mix((sums[end + LENGTH] - sums[begin]) * down[begin] + shape * np.uint64(0xC2B2AE3D27D4EB4F))
    text = np.searchsorted(at, begin, "right") - 1
    return text, begin - at[text], end - begin, anchor - begin, pieces[anchor], content


def _parts(at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, int]]:
    """Ranges of texts as ``low, high, cuts, skipped``; a long text comes in overlapping parts."""
    for low, high in slices(at, PART):
        begin, end = int(at[low]), int(at[high])
        if high - low > 1 or end - begin <= PART + LENGTH:
            yield low, high, at[low : high + 1], 0
            continue
        for skipped in range(0, end - begin - LENGTH + 1, PART):
            yield low, high, np.array([begin + skipped, min(end, begin + skipped + PART + LENGTH - 1)]), skipped


def _merged(id_: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    """Spans in the order of their places, those that touch or overlap as one."""
    order = np.lexsort((start, text, id_))
    id_, text, start, stop = id_[order], text[order], start[order].astype(np.int64), stop[order].astype(np.int64)
    same = np.zeros(len(id_), bool)
    same[1:] = (id_[1:] == id_[:-1]) & (text[1:] == text[:-1])
    group = np.cumsum(~same) * (1 << 32)
    reach = np.maximum.accumulate(group + stop)
    new = ~same
    new[1:] |= group[1:] + start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(id_)) - 1 if len(first) else first
    return pa.record_batch(
        [pa.array(id_[first]), pa.array(text[first]), pa.array(start[first].astype(np.int32)), pa.array((reach[last] - group[last]).astype(np.int32))],
        names=["id", "text", "start", "stop"],
    )


def _by_place(runs: np.ndarray, *keys: str) -> np.ndarray:
    """Runs sorted by the given fields, then by place."""
    return runs[np.lexsort((runs["start"], runs["text"], runs["id"], *[runs[k] for k in reversed(keys)]))]


def _repeats(runs: np.ndarray) -> np.ndarray:
    """Of sorted runs, those equal to the one before in anchor and content but not in place."""
    again = np.zeros(len(runs), bool)
    again[1:] = (runs["anchor"][1:] == runs["anchor"][:-1]) & (runs["content"][1:] == runs["content"][:-1])
    return again


def _removed(runs: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Repeats that have an earlier twin: rows that share id and text share their place, too, and all stay."""
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(runs))))
    same = (runs["id"] == runs["id"][head]) & (runs["text"] == runs["text"][head]) & (runs["start"] == runs["start"][head])
    return again & ~same


def _find_runs(buckets: int):
    """For ``mapInArrow``: runs in packed arrays by bucket, and, in bucket -1, spans already known to go."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, found = Powers(), []
        for batch in batches:
            data, at = bytes_and_offsets(batch.column("body"))
            ids, hashes = batch.column("id").to_numpy(), batch.column("hash").to_numpy()
            for low, _, cuts, skipped in _parts(at):
                text, start, more, back, anchor, content = _runs(data[cuts[0] : cuts[-1]], cuts - cuts[0], powers)
                runs = np.empty(len(text), _RUN)
                for name, value in zip(("anchor", "content", "id", "text", "start", "more", "back"), (anchor, content, ids[low + text], hashes[low + text], start + skipped, more, back)):
                    runs[name] = value
                found.append(runs)
        if not found:
            return
        runs = _by_place(np.concatenate(found), "anchor", "content")
        again = _repeats(runs)
        gone = runs[_removed(runs, again)]
        spans = _merged(gone["id"], gone["text"], gone["start"], gone["start"] + gone["more"].astype(np.int64) + LENGTH)
        runs = runs[~again]
        bucket = (runs["anchor"] % np.uint64(buckets)).astype(np.int64)
        runs = runs[np.lexsort((runs["start"], runs["text"], runs["id"], bucket))]
        bucket = (runs["anchor"] % np.uint64(buckets)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        columns = [pa.array(full.astype(np.int32))]
        columns += [pa.array([np.ascontiguousarray(runs[name][cuts[b] : cuts[b + 1]]).tobytes() for b in full], pa.binary()) for name, _ in _RUN]
        yield pa.record_batch(columns, names=["bucket", *[name for name, _ in _RUN]])
        # Spans are spread over the buckets, a few thousand in a row.
        for at in range(0, spans.num_rows, 4096):
            some = spans.slice(at, 4096)
            empty = pa.array([b""], pa.binary())
            packed = [pa.array([some.column(n).to_numpy().tobytes()], pa.binary()) for n in ("id", "text", "start", "stop")]
            yield pa.record_batch(
                [pa.array([-1 - (at // 4096) % buckets], pa.int32()), empty, packed[3], packed[0], packed[1], packed[2], empty, empty],
                names=["bucket", *[name for name, _ in _RUN]],
            )

    return rows


def _settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans that go because their whole run came earlier, and the open runs (``more`` is not null)."""
    found = []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] < 0:
                parts = [np.frombuffer(row[n], t) for n, t in (("id", np.int64), ("text", np.int64), ("start", np.int32), ("content", np.int32))]
                yield _row_batch(*parts)
                continue
            runs = np.empty(len(row["anchor"]) // 8, _RUN)
            for name, kind in _RUN:
                runs[name] = np.frombuffer(row[name], kind)
            found.append(runs)
    if not found:
        return
    runs = np.concatenate(found)
    del found
    anchors = np.sort(runs["anchor"])
    twice = np.unique(anchors[1:][anchors[1:] == anchors[:-1]])
    if not len(twice):
        return
    at = np.minimum(np.searchsorted(twice, runs["anchor"]), len(twice) - 1)
    runs = _by_place(runs[twice[at] == runs["anchor"]], "anchor", "content")
    again = _repeats(runs)
    gone = runs[_removed(runs, again)]
    yield _row_batch(gone["id"], gone["text"], gone["start"], gone["start"] + gone["more"].astype(np.int32) + np.int32(LENGTH))
    runs = runs[~again]
    _, where, contents = np.unique(runs["anchor"], return_inverse=True, return_counts=True)
    contents = contents[where]
    runs, contents = runs[contents > 1], contents[contents > 1]
    hot = (contents > HOT_CONTENTS).astype(np.uint8)
    stop = runs["start"] + runs["more"].astype(np.int32) + np.int32(LENGTH)
    yield _row_batch(runs["id"], runs["text"], runs["start"], stop, runs["back"], hot, runs["anchor"].view(np.int64))


def _row_batch(id_, text, start, stop, back=None, hot=None, anchor=None) -> pa.RecordBatch:
    n = len(id_)
    rest = [pa.nulls(n, t) if v is None else pa.array(np.ascontiguousarray(v).astype(k)) for v, t, k in ((back, pa.int16(), np.int16), (hot, pa.int16(), np.int16), (anchor, pa.int64(), np.int64))]
    first = [pa.array(np.ascontiguousarray(x).astype(k)) for x, k in ((id_, np.int64), (text, np.int64), (start, np.int32), (stop, np.int32))]
    return pa.record_batch([*first, *rest], names=["id", "text", "start", "stop", "back", "hot", "anchor"])


_OPEN = "id long, text long, start int, stop int, back short, hot short, anchor long"
_CONTEXT = "key long, shift short, id long, text long, start int, body binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each open run, keyed by its anchor; strings of hot anchors singly, keyed and compared by hash."""
    powers = Powers()
    for batch in batches:
        ids, texts = batch.column("id").to_numpy(), batch.column("hash").to_numpy()
        for row, (body, runs) in enumerate(zip(batch.column("body"), batch.column("runs").to_pylist())):
            raw = body.as_py().encode()
            out: list[tuple] = []
            for r in runs:
                if not r["hot"]:
                    out.append((r["anchor"], r["back"], r["start"], raw[r["start"] : r["stop"]]))
                    continue
                data = np.frombuffer(raw, np.uint8)[r["start"] : r["stop"]]
                up, down = powers.upto(len(data))
                n = len(data) - LENGTH + 1
                pair = []
                for values in _VALUES:
                    sums = _sums(data, values, up)
                    pair.append(mix((sums[LENGTH:] - sums[:-LENGTH]) * down[:n]))
                out += [(int(a.view(np.int64)), -1, r["start"] + i, a.tobytes() + b.tobytes()) for i, (a, b) in enumerate(zip(*pair))]
            if out:
                key, shift, start, pieces = zip(*out)
                n = len(out)
                yield pa.record_batch(
                    [
                        pa.array(key, pa.int64()),
                        pa.array(shift, pa.int16()),
                        pa.array(np.full(n, ids[row])),
                        pa.array(np.full(n, texts[row])),
                        pa.array(start, pa.int32()),
                        pa.array(pieces, pa.binary()),
                    ],
                    names=["key", "shift", "id", "text", "start", "body"],
                )


def _suffix_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of strings whose longest previous factor is ``LENGTH`` or more, of all contexts in this task."""
    table = gathered(batches)
    if table is None:
        return
    key, shift, id_, text, start = (table.column(n).to_numpy() for n in ("key", "shift", "id", "text", "start"))
    order = np.lexsort((start, text, id_, shift >= 0, key))
    key, shift, id_, text, start = key[order], shift[order], id_[order], text[order], start[order]
    body = table.column("body").combine_chunks().take(pa.array(order))
    offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
    data = np.frombuffer(body.buffers()[2], np.uint8)
    for single, size in ((True, 16), (False, LENGTH)):
        rows = np.flatnonzero((shift < 0) == single)
        if not len(rows):
            continue
        strings = np.diff(offsets)[rows] - size + 1
        ends = np.cumsum(strings)
        group_end = np.flatnonzero(np.append(key[rows][1:] != key[rows][:-1], True))
        low = 0
        while low < len(rows):
            done = ends[low - 1] if low else 0
            fits = np.searchsorted(ends[group_end], done + SORTED_AT_ONCE, "right") - 1
            nearest = np.searchsorted(group_end, low)
            high = int(group_end[max(fits, nearest)]) + 1
            some, n = rows[low:high], strings[low:high]
            owner = np.repeat(np.arange(len(some)), n)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            first = offsets[some][owner] + inner
            windows = np.lib.stride_tricks.sliding_window_view(data, size)[first]
            group = np.cumsum(np.append(0, key[some][1:] != key[some][:-1]))[owner]
            # Equal strings have their anchor at equal offsets, so the offset may sort before the bytes.
            depth = np.zeros(len(owner), np.int64) if single else shift[some][owner] - inner
            head = np.ascontiguousarray(windows).view(f"S{size}").ravel()
            suffixes = np.lexsort((np.arange(len(owner)), head, depth, group))
            g, d, h = group[suffixes], depth[suffixes], head[suffixes]
            block = np.zeros(len(suffixes), bool)
            block[1:] = (g[1:] == g[:-1]) & (d[1:] == d[:-1]) & (h[1:] == h[:-1])
            # Within a block the input order is the order of places, so its first is the smallest position.
            earliest = np.maximum.accumulate(np.where(block, 0, np.arange(len(suffixes))))
            mine, theirs = suffixes, suffixes[earliest]
            a, b = some[owner[mine]], some[owner[theirs]]
            same = (id_[a] == id_[b]) & (text[a] == text[b]) & (start[a] + inner[mine] == start[b] + inner[theirs])
            gone = mine[block & ~same]
            at = some[owner[gone]]
            begin = start[at] + inner[gone]
            yield _merged(id_[at], text[at], begin, begin + LENGTH)
            low = high


def repeated_spans(documents: DataFrame) -> DataFrame:
    """``id, text, start, stop``: bytes of documents to remove, spans possibly overlapping.

    ``id`` is the ``doc_id`` (the smallest long for null), ``text`` the xxhash64 of the text.
    """
    spark = documents.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = _bodies(documents)
    packed = ", ".join(["bucket int", *[f"{name} binary" for name, _ in _RUN]])
    settled = stored(body.mapInArrow(_find_runs(buckets), packed).repartition(buckets, "bucket").mapInArrow(_settle_runs, _OPEN), "runs")
    open_ = settled.where("anchor is not null")
    wanted = open_.groupBy("id", "text").agg(F.collect_list(F.struct("start", "stop", "back", "hot", "anchor")).alias("runs"))
    bodies = flag_probable(body, "id", open_.select("id"), "_may").where("_may").drop("_may")
    found = bodies.join(wanted.withColumnRenamed("text", "hash"), ["id", "hash"]).select("id", "hash", "body", "runs")
    contexts = found.mapInArrow(_contexts, _CONTEXT).repartition(buckets, "key")
    return settled.where("anchor is null").select("id", "text", "start", "stop").unionByName(contexts.mapInArrow(_suffix_blocks, _SPANS))


def _bodies(documents: DataFrame) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(body).alias("hash"), body.alias("body"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for body, spans in zip(batch.column("body"), batch.column("spans").to_pylist()):
            raw, pieces, at, removed, count = body.as_py().encode(), [], 0, 0, 0
            stop = -1
            for s in sorted(spans or [], key=lambda s: (s["start"], s["stop"])):
                if s["start"] > stop:
                    count += 1
                    pieces.append(raw[at : s["start"]])
                    at = stop = s["start"]
                if s["stop"] > stop:
                    removed += s["stop"] - stop
                    at = stop = s["stop"]
            pieces.append(raw[at:])
            rows.append((len(raw), removed, count, b"".join(pieces)))
        columns = list(zip(*rows)) or [(), (), (), ()]
        yield pa.record_batch(
            [batch.column("id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())],
            names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def without_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes, as a cut may fall inside a letter) for every row.

    Rows are ordered by ``doc_id`` (null first), rows of one id by a hash of their text; rows
    equal in both are one document, and none is earlier than the other. Texts under ``LENGTH``
    bytes stay whole, null is empty. Other columns aren't read. An empty table gives an empty result.
    """
    spans = stored(repeated_spans(documents), "spans")
    per_text = spans.groupBy("id", F.col("text").alias("hash")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    bodies = flag_probable(_bodies(documents), "id", spans.select("id"), "_may")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary"
    cut = bodies.where("_may").join(per_text, ["id", "hash"], "left").select("id", "body", "spans").mapInArrow(_cut, schema)
    none = F.lit(0).cast("long")
    whole = bodies.where("not _may").select(
        "id", F.octet_length("body").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.encode("body", "utf-8").alias("kept")
    )
    return cut.unionByName(whole).select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
