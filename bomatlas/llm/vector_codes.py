"""Vector codes: product quantisation whose distances are exact integers.

Components become integers, vectors are cut into equal parts, and each part is coded by its
nearest entry in that part's codebook. Distances need the dot products of all parts with all
entries. Integers are broken into limbs so short that a float64 matrix product of two limbs
sums below 2**53 and is exact; the products are put together again in int64, and the first
smallest distance wins. The fast matrix product thus gives the same codes on any machine.

Codebooks are learned by rounds of assignment and mean over all vectors. A task sends one sum
and one count per part and entry, which Spark adds up; a codebook has parts x entries rows,
whatever the number of vectors, and travels with the next round's tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bomatlas.llm.common import stored

#: Integer steps of one unit, parts of a vector, entries of a codebook, rounds of learning.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors worked on at once.
BLOCK = 2_048


def limit_of(width: int) -> int:
    """Largest integer component for which no distance or sum over a vector leaves int64."""
    return math.isqrt((1 << 62) // max(1, width)) // 2


def limb_bits(depth: int) -> int:
    """Bits of a limb: sums of ``depth`` products of two limbs stay below 2**53."""
    return (53 - max(1, depth).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as float64 limbs, lowest first; all but the highest lie in 0 to 2**bits - 1."""
    out = []
    while True:
        if not len(values) or -(1 << bits) < values.min() and values.max() < (1 << bits):
            return [*out, values.astype(np.float64)]
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits


def exact_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``left @ right.T`` of int64 matrices, exact as long as the results fit int64."""
    bits = limb_bits(left.shape[1])
    out = np.zeros((len(left), len(right)), np.int64)
    ours, theirs = limbs(left, bits), limbs(right, bits)
    for i, low in enumerate(ours):
        for j, high in enumerate(theirs):
            out += (low @ high.T).astype(np.int64) << np.int64(bits * (i + j))
    return out


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row and its squared distance, all int64."""
    # A row's own square is the same for all entries and joins after the choice.
    apart = np.einsum("ij,ij->i", entries, entries) - 2 * exact_products(rows, entries)
    first = apart.argmin(axis=1)
    return first, apart[np.arange(len(rows)), first] + np.einsum("ij,ij->i", rows, rows)


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]``: an int64 matrix with a row per entry. ``length``: components of a vector, a multiple of the parts."""

    entries: list[np.ndarray]
    length: int

    def text(self) -> str:
        """All components by part, entry and position, joined by commas."""
        return ",".join(str(v) for part in self.entries for v in part.ravel().tolist())


def _kept(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their integer components, zeros after the end of a shorter vector."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64(), safe=False)
    flat = values.fill_null(math.nan).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = column.is_valid().to_numpy(zero_copy_only=False)
    good[owner[~np.isfinite(flat)]] = False
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    use = good[owner]
    out = np.zeros((len(sizes), width), np.int64)
    most = float(limit_of(width))
    with np.errstate(over="ignore"):
        out[owner[use], at[use]] = np.clip(np.floor(scale * flat[use]), -most, most).astype(np.int64)
    return good, out[good]


def _blocks(batch: pa.RecordBatch, books: Codebooks, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for low in range(0, batch.num_rows, BLOCK):
        rows = batch.slice(low, BLOCK)
        good, values = _kept(rows.column("_vector"), books.length, scale)
        yield rows.filter(pa.array(good)), values


def _by_part(values: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(values, parts, axis=1)]


def _sums(vectors: DataFrame, books: Codebooks, scale: int) -> DataFrame:
    """``part, entry, n, sums``: for each part and entry, the parts nearest to it and their componentwise sums."""
    parts, width = len(books.entries), books.length // len(books.entries)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros_like(e) for e in books.entries]
        for batch in batches:
            for _, values in _blocks(batch, books, scale):
                for part, rows in enumerate(_by_part(values, parts)):
                    at, _ = nearest(rows, books.entries[part])
                    n[part] += np.bincount(at, minlength=len(n[part]))
                    # Sums of a block stay below 2**53, so doubles hold them exactly.
                    cell = (at[:, None] * width + np.arange(width)).ravel()
                    block = np.bincount(cell, rows.ravel(), sums[part].size)
                    sums[part] += block.astype(np.int64).reshape(sums[part].shape)
        for part in range(parts):
            used = np.flatnonzero(n[part])
            columns = [pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[part][used])]
            columns += [pa.array(sums[part][used, i]) for i in range(width)]
            yield pa.record_batch(columns, names=names)

    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]
    schema = "part int, entry int, n long" + "".join(f", s{i} long" for i in range(width))
    added = vectors.select("_vector").mapInArrow(add, schema)
    return added.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])


def _prepared(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    return vectors.select(
        F.col(f"`{id_column}`").alias("_id"), F.col(f"`{vector}`").alias("_vector"), F.col(f"`{label}`").alias("_label")
    )


def _usable(vector: str = "_vector"):
    """A vector without null and non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def _learned(rows: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> Codebooks:
    usable = rows.where(_usable())
    longest = usable.agg(F.max(F.size("_vector"))).first()[0] or 0
    length = parts * max(1, -(-longest // parts))
    # Top rows by id: at most ``entries`` of them leave each task and reach the driver.
    first = usable.select("_id", "_vector").orderBy(F.col("_id").asc_nulls_last(), "_vector").limit(entries).toArrow()
    start = first.column("_vector").combine_chunks()
    books = Codebooks(_by_part(_kept(start, length, scale)[1], parts), length)
    for _ in range(rounds if longest else 0):
        found = _sums(rows, books, scale).toArrow()
        part, entry, n = (found.column(c).to_numpy() for c in ("part", "entry", "n"))
        sums = np.stack([found.column(c).to_numpy() for c in found.column_names[3:]], axis=1)
        fresh = [e.copy() for e in books.entries]
        for p in range(parts):
            fresh[p][entry[part == p]] = sums[part == p] // n[part == p, None]
        books = Codebooks(fresh, length)
    return books


def learn(
    vectors: DataFrame,
    vector: str = "embedding",
    id_column: str = "vec_id",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> Codebooks:
    """Codebooks that begin as the parts of the vectors with the smallest ids and move to means over all vectors.

    Equal ids are ordered by vector, null ids come last. Fewer vectors than entries give
    smaller codebooks, none give empty ones. Of equally near entries the first is taken,
    entries without parts stay as they are.
    """
    return _learned(_prepared(vectors, id_column, vector, id_column), parts, entries, rounds, scale)


def encode(
    vectors: DataFrame,
    books: Codebooks,
    vector: str = "embedding",
    id_column: str = "vec_id",
    label: str = "label",
    scale: int = SCALE,
) -> DataFrame:
    """``_id, _label, code, error``: two hex digits for each part's entry (more where a codebook has over 256), and the squared distance."""
    parts = len(books.entries)
    digits = max(2, *[len(f"{max(0, len(e) - 1):x}") for e in books.entries])
    rows = _prepared(vectors, id_column, vector, label)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept, values in _blocks(batch, books, scale):
                if not kept.num_rows:
                    continue
                error = np.zeros(len(values), np.int64)
                chosen = []
                for part, own in enumerate(_by_part(values, parts)):
                    at, apart = nearest(own, books.entries[part])
                    error += apart
                    chosen.append(at)
                codes = ["".join(f"{a:0{digits}x}" for a in row) for row in np.stack(chosen, axis=1).tolist()]
                yield pa.record_batch([kept.column("_id"), kept.column("_label"), pa.array(codes, pa.string()), pa.array(error)], names=["_id", "_label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(code, f"_id {types['_id']}, _label {types['_label']}, code string, error long")


def compressed(
    vectors: DataFrame,
    vector: str = "embedding",
    id_column: str = "vec_id",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable vectors, ``<id>, code, error, label_error``, and the codebooks that decode them.

    Rows whose vector is null or holds a null or non-finite component are left out, as the
    only ones; repeated rows each have their code. Vectors shorter than the longest, or than
    the next multiple of ``parts``, count as followed by zeros; an empty vector is all zeros.
    Components beyond :func:`limit_of` are held at it, so that distances fit 64 bits (nothing
    under 2**27 is touched at 64 components). ``label_error`` sums ``error`` over the rows of a
    label, nulls together. No rows give an empty result. Extra columns are ignored whatever
    their names.
    """
    books = _learned(_prepared(vectors, id_column, vector, label), parts, entries, rounds, scale)
    coded = stored(encode(vectors, books, vector, id_column, label, scale), "codes")
    # One sum per label and task meets the codes again, so a frequent label is no hot group.
    errors = coded.groupBy(F.col("_label").alias("_of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(errors, F.col("_label").eqNullSafe(F.col("_of")))
    return out.select(F.col("_id").alias(id_column), "code", "error", "label_error"), books


def decode(codes: DataFrame, books: Codebooks, code: str = "code", scale: int = SCALE) -> DataFrame:
    """``codes`` with a column ``decoded``: the components that each code stands for."""
    digits = max(2, *[len(f"{max(0, len(e) - 1):x}") for e in books.entries])
    keep = [c for c in codes.columns if c != "decoded"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(code)).to_pylist()
            rows = [
                None if t is None else np.concatenate([e[int(t[i * digits : (i + 1) * digits], 16)] for i, e in enumerate(books.entries)]) / scale
                for t in texts
            ]
            yield pa.record_batch([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "decoded"])

    frame = codes.select(*[F.col(f"`{c}`") for c in keep])
    return frame.mapInArrow(read, T.StructType([*frame.schema.fields, T.StructField("decoded", T.ArrayType(T.DoubleType()))]))
