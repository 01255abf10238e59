"""N-gram Jaccard join by vertical partitioning.

All runs of words (n-grams, as 64-bit hashes) have one global order, from rare to frequent,
by a histogram of the whole corpus in slots of fixed number. The order is cut into fragments
of equal weight. Documents with equal sets are one node from the start. Nodes that share an
n-gram among their rarest (so many that linked sets must share one) are candidates; the sets
of each group of candidates are sent once, cut into fragments, overlaps are counted fragment
by fragment, and the counts of a pair are summed and compared with the threshold.

Each set has a signature of 1,024 parities. Bits that differ are n-grams only one of two sets
has, so a pair with too many of them can't be similar enough: chance company in a list goes
before any set is sent. Sizes too far apart end a list's run of neighbours likewise.

Links are only needed to join groups, so pairs are tested in rounds: first neighbours in each
n-gram's list, by size and then in a random order, which joins nearly all that belongs
together in a number of pairs that is linear in the lists; last, exactly, every pair that
shares a rare n-gram and is still apart. A large group of near copies therefore never
lists all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bomatlas.llm.common import probably_in, stored, thinned, without_ids
from bomatlas.llm.components import components
from bomatlas.llm.tokens import Powers, bytes_and_offsets, gathered, mix, sets_of, slices, words_of

#: Words of an n-gram and least similarity in hundredths.
WORDS, PERCENT = 4, 85
#: Slots of the histogram, by the first bits of an n-gram's hash (1 MB a task), in chunks.
SLOT_BITS, CHUNK = 18, 1 << 12
#: Fragments of the global order; a group of candidates with more n-grams than ``GROUP_GRAMS`` in each is cut finer.
FRAGMENTS, GROUP_GRAMS = 4, 1 << 19
#: Rounds of tests between neighbours in a list, in different orders.
ROUNDS = 2
#: Members of a list that are handed on together.
LIST_PART = 1024
#: Bits of a set's signature, and members up to which all pairs of a list are compared by it.
SIGNATURE_BITS, SHORT_LIST = 1024, 64
#: Word lookups done at once when overlaps are counted.
COUNTED_AT_ONCE = 1 << 19

_SIGNATURE_WORDS = SIGNATURE_BITS // 64
_SHIFT = np.uint64(64 - SLOT_BITS)


def _set_id(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _emitted(rows: list[tuple], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 1000):
        columns = zip(*rows[at : at + 1000])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))


_PARTNERS = "set_id long, n int, group long, others binary, ns binary"
_PARTNER_TYPES = {"set_id": pa.int64(), "n": pa.int32(), "group": pa.int64(), "others": pa.binary(), "ns": pa.binary()}


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """For each slice of each batch: the batch, its first row, distinct n-grams and where each row's begin."""
    powers = Powers()
    for batch in batches:
        data, at = bytes_and_offsets(batch.column("text"))
        for low, high in slices(at):
            grams, first = sets_of(words_of(data, at[low : high + 1], powers), words)
            yield batch, low, grams, first


def _signatures(grams: np.ndarray, first: np.ndarray) -> list[bytes]:
    """For each set the parity, per residue, of its number of n-grams."""
    out: list[bytes] = []
    for low in range(0, len(first) - 1, 2048):
        ends = first[low : low + 2049]
        of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        bit = (grams[ends[0] : ends[-1]] % np.uint64(SIGNATURE_BITS)).astype(np.int64)
        odd = np.bincount(of * SIGNATURE_BITS + bit, minlength=(len(ends) - 1) * SIGNATURE_BITS) & 1
        out += [row.tobytes() for row in np.packbits(odd.astype(bool).reshape(-1, SIGNATURE_BITS), axis=1)]
    return out


def _may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes ``n`` and ``m`` may be similar enough; ``a`` and ``b`` hold a signature a row."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    return fits & (differ * (100 + percent) <= (n + m) * (100 - percent))


def _signature_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, _SIGNATURE_WORDS)


def _survey(words: int):
    """For ``mapInArrow``: size, set id and signature of each document, and the slots' counts of the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "set_id", "chunk", "counts", "signature"]
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch, low, grams, first in _sets(batches, words):
            total += np.bincount((grams >> _SHIFT).astype(np.int64), minlength=len(total))
            n = np.diff(first)
            ids = [_set_id(grams[a:b]) if b > a else None for a, b in zip(first[:-1], first[1:])]
            yield pa.record_batch(
                [batch.column("doc_id").slice(low, len(n)), pa.array(n), pa.array(ids, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), pa.array(_signatures(grams, first), pa.binary())],
                names=names,
            )
        parts = [total[i : i + CHUNK].astype(np.int32).tobytes() for i in range(0, len(total), CHUNK)]
        n = len(parts)
        yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary()), pa.nulls(n, pa.binary())], names=names)

    return rows


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
    yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "counts"])


def _rare(sent, words: int, percent: int, buckets: int):
    """For ``mapInArrow``: the rarest n-grams of each distinct set, as packed arrays dealt by n-gram."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_counts = sent.value[0]
        found, seen = [], set()
        for _, _, grams, first in _sets(batches, words):
            n = np.diff(first)
            of = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((grams, slot_counts[(grams >> _SHIFT).astype(np.int64)], of))
            wanted = n - (percent * n + 99) // 100 + 1
            for i in np.flatnonzero(n):
                name = _set_id(grams[first[i] : first[i + 1]])
                if name in seen:
                    continue
                seen.add(name)
                rare = grams[order[first[i] : first[i] + wanted[i]]]
                found.append((rare, np.full(len(rare), name), np.full(len(rare), n[i], np.int32)))
        if not found:
            return
        gram, name, size = (np.concatenate(x) for x in zip(*found))
        bucket = (gram % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        columns = [pa.array(full.astype(np.int32))]
        columns += [pa.array([x[order[cuts[b] : cuts[b + 1]]].tobytes() for b in full], pa.binary()) for x in (gram, name, size)]
        yield pa.record_batch(columns, names=["bucket", "grams", "sets", "sizes"])

    return rows


def _shared(percent: int):
    """For ``mapInArrow``: the members of every list that has two or more of fitting size.

    Sorted by size, a list ends where the next set is too large for the one before: sets on
    both sides of such a gap can't link. Each piece is a list of its own, numbered by a hash of
    its members, so that equal lists (near copies share most of theirs) can be dropped. Members
    come packed, ``LIST_PART`` in a row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.frombuffer(g, np.uint64), np.frombuffer(s, np.int64), np.frombuffer(n, np.int32)) for b in batches for g, s, n in zip(*(b.column(c).to_pylist() for c in ("grams", "sets", "sizes")))]
        if not parts:
            return
        gram, name, size = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((name, size, gram))
        gram, name, size = gram[order], name[order], size[order].astype(np.int64)
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (name[1:] != name[:-1])
        gram, name, size = gram[new], name[new], size[new]
        begins = np.ones(len(gram), bool)
        begins[1:] = (gram[1:] != gram[:-1]) | (100 * size[:-1] < percent * size[1:])
        starts = np.flatnonzero(begins)
        members = np.diff(np.append(starts, len(gram)))
        number = mix(np.add.reduceat(mix(name.view(np.uint64)), starts) + members.astype(np.uint64)).view(np.int64)
        order = np.flatnonzero(members > 1)
        _, first = np.unique(number[order], return_index=True)
        out = [
            (number[i], name[low : min(low + LIST_PART, starts[i] + members[i])].tobytes(), size[low : min(low + LIST_PART, starts[i] + members[i])].astype(np.int32).tobytes())
            for i in order[first]
            for low in range(starts[i], starts[i] + members[i], LIST_PART)
        ]
        yield from _emitted(out, {"gram": pa.int64(), "sets": pa.binary(), "sizes": pa.binary()})

    return rows


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each member of a packed list."""
    for batch in batches:
        if batch.num_rows:
            sets, sizes = (batch.column(c).to_pylist() for c in ("sets", "sizes"))
            n = [len(s) // 4 for s in sizes]
            gram = np.repeat(batch.column("gram").to_numpy(), n)
            yield pa.record_batch(
                [pa.array(gram), pa.array(np.frombuffer(b"".join(sets), np.int64)), pa.array(np.frombuffer(b"".join(sizes), np.int32))], names=["gram", "set_id", "n"]
            )


def _without_strangers(percent: int):
    """For ``mapInArrow``: members of short lists only if a signature there may be similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gathered(batches)
        if table is None:
            return
        gram = table.column("gram").to_numpy()
        order = np.argsort(gram, kind="stable")
        n = table.column("n").to_numpy().astype(np.int64)
        signs = _signature_rows(table.column("signature").combine_chunks())
        starts = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1]))
        members = np.diff(np.append(starts, len(gram)))
        kept = np.zeros(len(gram), bool)
        kept[order[np.repeat(members > SHORT_LIST, members)]] = True
        for size in range(2, SHORT_LIST + 1):
            for low in range(0, int((members == size).sum()), 4096):
                lists = starts[members == size][low : low + 4096]
                for i in range(size):
                    for j in range(i):
                        a, b = order[lists + i], order[lists + j]
                        some = _may_link(signs[a], signs[b], n[a], n[b], percent)
                        kept[a[some]] = True
                        kept[b[some]] = True
        yield from table.filter(pa.array(kept)).to_batches()

    return rows


def _segments(sent, words: int):
    """For ``mapInArrow``: the n-grams of the wanted sets, by group and fragment."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fragment_of = sent.value[1]
        for batch, low, grams, first in _sets(batches, words):
            wanted, groups, cuts = (batch.column(c).to_numpy()[low:] for c in ("set_id", "group", "cuts"))
            out: list[tuple] = []
            for i in range(len(first) - 1):
                mine = grams[first[i] : first[i + 1]]
                if not len(mine) or _set_id(mine) != wanted[i]:
                    continue  # another text with the id of a wanted one
                # A finer cut divides each fragment by the n-grams' last bits.
                finer = int(cuts[i]) // FRAGMENTS
                part = fragment_of[(mine >> _SHIFT).astype(np.int64)].astype(np.int64) * finer + (mine % np.uint64(finer)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(cuts[i] + 1))
                for p in np.flatnonzero(np.diff(ends)):
                    out.append((groups[i], p, wanted[i], mine[order[ends[p] : ends[p + 1]]].tobytes()))
            if out:
                group, p, name, body = zip(*out)
                yield pa.record_batch(
                    [pa.array(group, pa.int64()), pa.array(p, pa.int32()), pa.array(name, pa.int64()), pa.array(body, pa.binary())],
                    names=["group", "part", "set_id", "grams"],
                )

    return rows


def _count_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set with partners, and each part it is in, the n-grams it shares there with each partner."""
    table = gathered(batches)
    if table is None:
        return
    held, asked = table.filter(pc.is_valid(table.column("grams"))), table.filter(pc.is_valid(table.column("others")))
    del table
    if not held.num_rows:
        return
    grams = held.column("grams").combine_chunks()
    lengths = pc.binary_length(grams).to_numpy() // 8
    first = grams.slice(0, 1).buffers()
    begin = int(np.frombuffer(first[1], np.int32)[grams.offset])
    known, flat = np.unique(np.frombuffer(first[2], np.uint8)[begin : begin + 8 * int(lengths.sum())].view(np.uint64), return_inverse=True)
    del first, grams
    keys = np.sort(np.repeat(np.arange(len(lengths)), lengths) * len(known) + flat)
    starts = np.append(0, np.cumsum(lengths))
    where = {key: k for k, key in enumerate(zip(*(held.column(c).to_pylist() for c in ("part", "set_id"))))}
    part, name, others = (asked.column(c).to_pylist() for c in ("part", "set_id", "others"))
    out: list[tuple] = []
    for i in range(len(name)):
        mine = where.get((part[i], name[i]))
        partners = np.frombuffer(others[i], np.int64)
        counts = np.zeros(len(partners), np.int32)
        if mine is not None:
            own = flat[starts[mine] : starts[mine + 1]]
            theirs = np.array([where.get((part[i], p), -1) for p in partners.tolist()])
            step = max(1, COUNTED_AT_ONCE // max(len(own), 1))
            for a in range(0, len(partners), step):
                some = theirs[a : a + step]
                sought = (some[:, None] * len(known) + own[None, :]).ravel()
                at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
                hit = (keys[at] == sought).reshape(len(some), -1)
                hit[some < 0] = False
                counts[a : a + step] = hit.sum(axis=1)
        out.append((name[i], others[i], counts.tobytes()))
    yield from _emitted(out, {"set_id": pa.int64(), "others": pa.binary(), "counts": pa.binary()})


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every set that is compared, on either side."""
    for batch in batches:
        others = np.frombuffer(b"".join(batch.column("others").to_pylist()), np.int64)
        yield pa.record_batch([pa.array(np.unique(np.concatenate([batch.column("set_id").to_numpy(), others])))], names=["set_id"])


def _links(percent: int):
    """For ``mapInArrow``: sum the counts of each pair and keep those similar enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, bytes], np.ndarray] = {}
        sizes: dict[tuple[int, bytes], tuple[int, bytes]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["set_id"], row["others"])
                if row["counts"] is None:
                    sizes[key] = (row["n"], row["ns"])
                else:
                    sums[key] = sums.get(key, 0) + np.frombuffer(row["counts"], np.int32)
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for (name, others), shared in sums.items():
            n, ns = sizes[name, others]
            both = n + np.frombuffer(ns, np.int32).astype(np.int64) - shared
            linked = np.frombuffer(others, np.int64)[100 * shared.astype(np.int64) >= percent * both]
            left.append(np.full(len(linked), name))
            right.append(linked)
        yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["u", "v"])

    return rows


def _apart(percent: int):
    """For ``mapInArrow``: in a row, a part of a list and some of its sets that ask: who may link with whom."""

    def signatures(rows: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(rows), np.uint64).reshape(-1, _SIGNATURE_WORDS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a row may be a thousand sets
                (row,) = batch.slice(i, 1).to_pylist()
                sets, labels, sizes = (np.array([m[c] for m in row["members"]], np.int64) for c in ("set_id", "label", "n"))
                signs = signatures([m["signature"] for m in row["members"]])
                out: list[tuple] = []
                for own, sign in zip(row["asking"], signatures([a["signature"] for a in row["asking"]])):
                    fits = (labels != own["label"]) & _may_link(signs, sign, sizes, np.int64(own["n"]), percent)
                    if fits.any():
                        out.append((own["set_id"], own["n"], own["group"], sets[fits].tobytes(), sizes[fits].astype(np.int32).tobytes()))
                yield from _emitted(out, _PARTNER_TYPES)

    return rows


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each set with all its distinct partners, without those in ``done``."""
    found: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            entry = found.setdefault(row["set_id"], [row["n"], row["group"], [], [], []])
            if row["done"] is not None:
                entry[4].append(row["done"])
            else:
                entry[0], entry[1] = row["n"], row["group"]
                entry[2].append(row["others"])
                entry[3].append(row["ns"])
    out: list[tuple] = []
    for name, (n, group, others, ns, done) in found.items():
        partners, first = np.unique(np.frombuffer(b"".join(others), np.int64), return_index=True)
        sizes = np.frombuffer(b"".join(ns), np.int32)[first]
        fresh = ~np.isin(partners, np.array(done, np.int64))
        if fresh.any():
            out.append((name, n, group, partners[fresh].tobytes(), sizes[fresh].tobytes()))
    yield from _emitted(out, _PARTNER_TYPES)


def _by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flat pairs as one row a set, with all its partners and their sizes."""
    table = gathered(batches)
    if table is None:
        return
    name, n, group, other, size = (table.column(c).to_numpy() for c in ("set_id", "n", "group", "other", "other_n"))
    order = np.argsort(name, kind="stable")
    first = np.flatnonzero(np.append(True, name[order][1:] != name[order][:-1]))
    out = [
        (name[some[0]], n[some[0]], group[some[0]], other[some].tobytes(), size[some].astype(np.int32).tobytes())
        for some in np.split(order, first[1:])
    ]
    yield from _emitted(out, _PARTNER_TYPES)


def _packed(pairs: DataFrame, buckets: int) -> DataFrame:
    """Distinct flat pairs as one row a set."""
    return pairs.repartition(buckets, "set_id").mapInArrow(_by_set, _PARTNERS)


def _tested(partners: DataFrame, segments: DataFrame, groups: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Links ``u, v`` among the sets and partners given, by counts per fragment summed per pair."""
    blank = F.lit(None).cast("binary")
    asked = (
        partners.join(groups, "group")
        .select("group", F.explode(F.expr("sequence(0, cuts - 1)")).alias("part"), "set_id", blank.alias("grams"), "others")
    )
    # Only sets that are compared now need to move; a few more do no harm.
    involved = partners.mapInArrow(_involved, "set_id long").distinct()
    held = thinned(segments, "set_id", involved).select("group", "part", "set_id", "grams", blank.alias("others"))
    counts = held.unionByName(asked).repartition(buckets, "group", "part").mapInArrow(_count_overlaps, "set_id long, others binary, counts binary")
    sizes = partners.select("set_id", "others", blank.alias("counts"), "n", "ns")
    nothing = [F.lit(None).cast("int").alias("n"), blank.alias("ns")]
    return counts.select("set_id", "others", "counts", *nothing).unionByName(sizes).repartition(buckets, "set_id").mapInArrow(_links(percent), "u long, v long")


def _neighbours(lists: DataFrame, labels: DataFrame | None, order: list, percent: int) -> DataFrame:
    """Each member of a list with the one before it, if the two are apart and may link."""
    rows = lists if labels is None else _labelled(lists, labels)
    # A long list is cut at random into short ones: any neighbours will do here.
    salt = F.pmod(F.xxhash64("set_id", F.lit(len(order))), F.greatest(F.lit(1), F.expr(f"members div {LIST_PART}")))
    row = Window.partitionBy("gram", "_salt").orderBy(*order)
    columns = ["set_id", "n", "signature", *(["label"] if labels is not None else [])]
    before = F.lag(F.struct(*columns)).over(row)
    paired = rows.withColumn("_salt", salt).select("group", *columns, before.alias("_before")).where("_before is not null")
    if labels is not None:
        paired = paired.where("label <> _before.label")
    pairs = paired.select("set_id", "n", "group", "signature", F.col("_before.set_id").alias("other"), F.col("_before.n").alias("other_n"), F.col("_before.signature").alias("other_signature"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (_signature_rows(batch.column(c)) for c in ("signature", "other_signature"))
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "other_n"))
            some = batch.filter(pa.array(_may_link(a, b, n, m, percent)))
            yield some.select(["set_id", "n", "group", "other", "other_n"])

    return pairs.mapInArrow(likely, "set_id long, n int, group long, other long, other_n int").distinct()


def _labelled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    return lists.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("component", "set_id")).drop("component")


def _still_apart(lists: DataFrame, labels: DataFrame, done: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Every pair in a common list, in different components, that was not tested yet.

    In each list the largest component asks nobody: all others ask it, and one another.
    """
    rows = stored(_labelled(lists, labels), "labelled")
    sizes = rows.groupBy("gram", "label").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("gram").agg(F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    asking = rows.join(largest.select("gram", F.col("top.label").alias("_top")), "gram").where("label <> _top")

    def parts(of: DataFrame, name: str) -> DataFrame:
        """Lists in parts of bounded size, so a row of the join below stays small."""
        part = F.pmod(F.xxhash64("set_id"), F.greatest(F.lit(1), F.expr(f"members div {LIST_PART}")))
        member = F.struct("set_id", "n", "group", "label", "signature")
        return of.groupBy("gram", part.alias("_part")).agg(F.collect_list(member).alias(name)).drop("_part")

    members = parts(rows.join(largest.select("gram"), "gram", "left_semi"), "members")
    found = parts(asking, "asking").join(members, "gram").select("asking", "members").mapInArrow(_apart(percent), _PARTNERS)
    old = done.select("set_id", F.lit(None).cast("int").alias("n"), F.lit(None).cast("long").alias("group"), *[F.lit(None).cast("binary").alias(c) for c in ("others", "ns")], F.col("other").alias("done"))
    return found.withColumn("done", F.lit(None).cast("long")).unionByName(old).repartition(buckets, "set_id").mapInArrow(_gather, _PARTNERS)


def near_groups(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents``.

    A document's set is its distinct runs of ``words`` words, A-Z as a-z; a shorter text is one
    run, and a null text, or one without words, is empty and linked with nothing. Two documents
    link when 100 * intersection >= percent * union; ``component_id`` is the smallest id
    reachable by links. Rows that share an id are rows of their own; a null id is no number to
    reach, and a set that only rows without an id have links nothing. Other columns aren't read.
    """
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    survey = stored(texts.mapInArrow(_survey(words), "doc_id long, n long, set_id long, chunk int, counts binary, signature binary"), "survey")
    slot_counts = np.zeros(1 << SLOT_BITS, np.int64)
    for chunk, counts in survey.where("chunk is not null").select("chunk", "counts").repartition((1 << SLOT_BITS) // CHUNK, "chunk").mapInArrow(_add_counts, "chunk int, counts binary").collect():
        slot_counts[chunk * CHUNK : (chunk + 1) * CHUNK] += np.frombuffer(counts, np.int64)
    # Fragments of equal weight in the global order (slots by count, then by number).
    order = np.argsort(slot_counts, kind="stable")
    weight = np.cumsum(slot_counts[order])
    fragment_of = np.zeros(1 << SLOT_BITS, np.uint8)
    fragment_of[order] = np.minimum(weight * FRAGMENTS // max(int(weight[-1]), 1), FRAGMENTS - 1)
    sent = spark.sparkContext.broadcast((slot_counts, fragment_of))

    sized = survey.where("chunk is null").select("doc_id", F.col("n").alias("n_shingles"), "set_id")
    packed = texts.mapInArrow(_rare(sent, words, percent, buckets), "bucket int, grams binary, sets binary, sizes binary")
    lists = packed.repartition(buckets, "bucket").mapInArrow(_shared(percent), "gram long, sets binary, sizes binary").distinct()
    lists = lists.mapInArrow(_members, "gram long, set_id long, n int")
    signatures = survey.where("set_id is not null").dropDuplicates(["set_id"]).select("set_id", "signature")
    close = lists.join(signatures, "set_id").select("gram", "set_id", "n", "signature").repartition(buckets, "gram")
    lists = stored(close.mapInArrow(_without_strangers(percent), "gram long, set_id long, n int, signature binary"), "lists")
    per_list = lists.groupBy("gram").agg(F.min("set_id").alias("v"), F.count("*").alias("members"))
    joined = lists.join(per_list, "gram")
    candidates = components(joined.select(F.col("set_id").alias("u"), "v"), "candidates").select(F.col("node").alias("set_id"), F.col("component").alias("group"))
    candidates = stored(candidates, "candidates")
    lists = stored(joined.join(candidates, "set_id").select("gram", "set_id", "n", "signature", "group", "members"), "lists")

    total = lists.select("set_id", "n", "group").distinct().groupBy("group").agg(F.sum("n").alias("_grams"))
    cuts = (F.ceil(F.col("_grams") / (FRAGMENTS * GROUP_GRAMS)) * FRAGMENTS).cast("int")
    groups = stored(total.select("group", cuts.alias("cuts")), "groups")
    first = sized.where("set_id is not null and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    wanted = stored(candidates.join(first, "set_id").join(groups, "group").select("doc_id", "set_id", "group", "cuts"), "wanted")
    # Both sides grow with the corpus, so this join is by shuffle at any size.
    bodies = probably_in(texts.where("doc_id is not null"), "doc_id", wanted.select("doc_id")).join(wanted.hint("merge"), "doc_id")
    segments = stored(bodies.mapInArrow(_segments(sent, words), "group long, part int, set_id long, grams binary"), "segments")

    links = done = labels = None
    for number in range(ROUNDS + 1):
        if number < ROUNDS:
            order_by = [F.col("n"), F.col("set_id")] if number == 0 else [F.xxhash64("gram", "set_id", F.lit(number)), F.col("set_id")]
            pairs = stored(_neighbours(lists, labels, order_by, percent), "pairs")
            partners = stored(_packed(pairs, buckets), "partners")
            both = pairs.select("set_id", "other").unionByName(pairs.select(F.col("other").alias("set_id"), F.col("set_id").alias("other")))
            done = both if done is None else done.unionByName(both)
        else:
            partners = stored(_still_apart(lists, labels, done, percent, buckets), "partners")
        found = stored(_tested(partners, segments, groups, percent, buckets), "links")
        links = found if links is None else links.unionByName(found)
        labels = stored(components(links, "linked"), "labels")
    nodes = sized.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("_group", F.coalesce("component", "set_id"))
    smallest = nodes.where("set_id is not null").groupBy("_group").agg(F.min("doc_id").alias("component_id"))
    return nodes.join(smallest, "_group", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(documents: DataFrame, words: int, percent: int) -> DataFrame:
    """``documents`` with the row of smallest id of each group. Rows that share an id stay or go together."""
    groups = near_groups(documents, words, percent).where("doc_id is not null")
    follows = groups.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("_follows"))
    return without_ids(documents, stored(follows.where("_follows").select("doc_id"), "followers"))
